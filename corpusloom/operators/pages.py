"""Header and footer removal on page-marked text: one projection over a text's pages, no shuffle and no key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, lines, n_bytes, pin, text, utrim

MARKER = r"^## 第 (\d+)"
HEAD, FOOT, SHARE, SHORTEST, LONGEST, FEWEST_PAGES = 3, 3, 0.7, 3, 200, 3
PAGE_NUMBER = r"^([-—–]\s*\d+\s*[-—–]|[0-9]{1,4})\z"


def page_array(c: Column) -> Column:
    """array<struct<page, line array, m array>>: a text's pages with lines, and their trimmed lines. Text before the first marker is no page."""
    marked = F.concat(F.lit("\n"), F.regexp_replace(c, "\r\n", "\n"))
    parts = let(F.split(marked, r"(?<=\n)(?=## 第 \d)", -1), lambda p: F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))))
    body = lambda x: let(lines(x), lambda ls: F.slice(ls, 2, F.greatest(F.size(ls) - 1, F.lit(0))))
    each = F.transform(parts, lambda x: F.struct(F.regexp_extract(x, MARKER, 1).alias("page"), body(x).alias("line")))
    return F.transform(F.filter(each, lambda x: F.size(x["line"]) > 0), lambda x: F.struct(x["page"].alias("page"), x["line"].alias("line"), F.transform(x["line"], utrim).alias("m")))


def _often(near: Column, least: Column) -> Column:
    """The strings that stand at least ``least`` times in an array.

    In sorted order such a run covers a place that is a multiple of ``least``, so only those few are counted.
    """

    def found(s: Column) -> Column:
        some = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / least).cast("int")), lambda i: F.get(s, (i * least).cast("int")))
        return F.filter(F.array_distinct(some), lambda m: F.size(F.filter(s, lambda x: x == m)) >= least)

    return let(F.array_sort(near), lambda s: F.when(F.size(s) > 0, found(s)).otherwise(F.array().cast("array<string>")))


def strip_headers_footers(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, text, pages, removed) for each row by itself; documents under three pages stay as they are.

    A null text is an empty one. Repeated and null keys do no harm.
    """
    d = docs.select(F.col(key).alias("key"), text(column).alias("t")).withColumn("p", page_array(F.col("t")))
    d = pin(d.withColumn("pages", F.when(F.size("p") >= FEWEST_PAGES, F.size("p"))))
    fit = lambda m: F.length(m).between(SHORTEST, LONGEST)
    last = lambda x: F.slice(x["m"], F.greatest(F.size(x["m"]) - FOOT + 1, F.lit(1)), FOOT)
    q = F.ceil(SHARE * F.col("pages"))
    d = d.withColumn("heads", _often(F.filter(F.flatten(F.transform("p", lambda x: F.slice(x["m"], 1, HEAD))), fit), q))
    d = d.withColumn("feet", _often(F.filter(F.flatten(F.transform("p", last)), fit), q))
    d = d.withColumn("numbers", F.array_distinct(F.filter(F.flatten(F.transform("p", last)), lambda m: m.rlike(PAGE_NUMBER))))

    def gone(x: Column, i: Column) -> Column:
        m, up, down = F.get(x["m"], i), i + 1, F.size(x["m"]) - i
        hit = lambda c: F.exists(c, lambda h: F.contains(m, h) | F.contains(h, m))
        return (n_bytes(m) > 0) & (((up <= F.size("heads") + 2) & hit("heads")) | ((down <= F.size("feet") + 2) & hit("feet")) | (m.rlike(PAGE_NUMBER) & F.array_contains("numbers", m)))

    kept = F.transform("p", lambda x: F.struct(x["page"].alias("page"), F.filter(x["line"], lambda _, i: ~gone(x, i)).alias("line"), F.size(x["line"]).alias("n")))
    d = pin(d.withColumn("kept", F.when(F.col("pages").isNotNull(), kept)))
    one = lambda x: F.concat(F.lit("## 第 "), x["page"], F.lit(" 页\n\n"), F.array_join(x["line"], "\n"))
    removed = F.aggregate("kept", F.lit(0).cast("long"), lambda a, x: a + x["n"] - F.size(x["line"]))
    return d.select(
        F.col("key").alias(key), F.coalesce(F.array_join(F.transform("kept", one), "\n\n"), "t").alias("text"),
        F.coalesce("pages", F.lit(1)).cast("long").alias("pages"), F.coalesce(removed, F.lit(0)).cast("long").alias("removed"),
    )
