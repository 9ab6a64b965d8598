"""Column helpers. Lengths in bytes and in characters are different things here; names say which."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CJK = "一-鿿㐀-䶿　-〿"
#: Everything a clean text may hold: tab, line ends, ASCII, CJK, CJK and full-width punctuation, extensions A and B.
PRINTABLE = r"\t\n\r\x20-\x7E一-鿿　-〿＀-￯㐀-䶿\x{20000}-\x{2A6DF}"


def text(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def lines(c: Column) -> Column:
    """Lines without their ends; a last empty line is none, and an empty text has no lines."""
    parts = F.split(F.regexp_replace(c, "\r\n", "\n"), "\n", -1)
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def utrim(c: Column) -> Column:
    """Trim all Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def n_bytes(c: Column) -> Column:
    return F.octet_length(c)


def count_class(c: Column, chars: str) -> Column:
    """How many characters of a class a text has."""
    return (F.length(c) - F.length(F.regexp_replace(c, f"[{chars}]+", ""))).cast("long")


def count_sub(c: Column, sub: str) -> Column:
    """Non-overlapping occurrences of a string."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(sub), F.lit("")))) / len(sub)).cast("long")


def one_decimal(c: Column) -> Column:
    """A double of 0 or more with one decimal as C prints it: the binary value is rounded, and only a true tie goes to the even digit.

    Java's ``%.1f`` rounds the shortest decimal form, half up. Here 10 x is 8 x + 2 x, both exact, and what their sum loses is known.
    """

    def tenths(x: Column) -> Column:
        ten, low = x * 10, F.floor(x * 10)
        lost = x * 2 - (ten - x * 8)
        part = ten - low
        up = (part > 0.5) | (part == 0.5) & ((lost > 0) | (lost == 0) & (low % 2 == 1))
        return low + F.when(up, 1).otherwise(0)

    return let(let(c, tenths), lambda n: F.concat(F.floor(n / 10), F.lit("."), n % 10))


def shingles(c: Column, k: int | Column) -> Column:
    """The set of character k-shingles; a shorter text is its only shingle."""
    k = F.lit(k) if isinstance(k, int) else k
    n = F.length(c)
    return F.when(n < k, F.array(c)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(c, i, k))))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of which neither is empty."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def pin(df: DataFrame) -> DataFrame:
    """``df`` as it is, but no later filter moves below it.

    A filter that moves below a chain of derived columns takes a copy of each of them, and of each that those use;
    over many steps that grows without bound. Below a column that is not deterministic nothing moves.
    """
    return df.withColumn("_pin", F.monotonically_increasing_id()).where("_pin >= 0").drop("_pin")
