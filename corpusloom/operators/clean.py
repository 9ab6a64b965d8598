"""Text cleaning in six steps of a fixed order, as columns over the array of lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CJK, let, lines, n_bytes, utrim

# fixed values
DOMAIN = r"(?i)(epubw\.[a-z]+|libgen\.[a-z]+|zlibrary-[a-z]+)"
PROMO = r"(?iuU)(电子书\s*下载|免费\s*下载|本书由.*整理|仅供学习|请勿商用|版权所有|all rights reserved|download.*ebook|free.*pdf|scanned by)"
LOUD = r"[!！]{3,}|[?？]{3,}|[.。]{4,}"
TOC_ENTRY = (
    r"^(第[\d一二三四五六七八九十百千]+章.*|[一二三四五六七八九十百千]+[、．.]\s*.*|（[一二三四五六七八九十]）.*|Chapter\s+\d+.*|CHAPTER\s+[IVX\d]+.*|Part\s+[IVX\d]+.*|Section\s+\d+.*|\d+(\.\d+)*\s+\S+.*|[A-Z]\.\s+\S+.*|[IVX]+\.\s+\S+.*"
    r"|推荐语|前言|序言|目录|Preface|Introduction|Contents|致谢|Acknowledgments|摘要|Abstract)\s*\Z"
)
SENTENCE_END = r"[。．.！!?？…、,；;：:\-–—~]\z"


def page_breaks(t: Column) -> Column:
    """Form feeds become blank lines; three or more line ends become two."""
    return F.regexp_replace(F.replace(t, F.lit("\f"), F.lit("\n\n")), "\n{3,}", "\n\n")


def drop_watermarks(t: Column) -> Column:
    """Drop lines with a known domain (under 80 bytes), promotion words or extreme punctuation."""
    noise = lambda m: (m.rlike(DOMAIN) & (n_bytes(m) < 80)) | m.rlike(PROMO) | m.rlike(LOUD)
    return F.array_join(F.filter(lines(t), lambda x: ~let(utrim(x), noise)), "\n")


def normal_line(m: Column) -> Column:
    """A trimmed line without its page number."""
    return F.regexp_replace(m, r"(?U)[\s.\-–—]+\d+\s*\z", "")


def drop_repeated(t: Column, threshold: int = 5) -> Column:
    """Drop lines whose normal form occurs ``threshold`` times among lines of five bytes or more."""
    each = F.transform(lines(t), lambda x: let(utrim(x), lambda m: F.struct(x.alias("x"), normal_line(m).alias("n"), n_bytes(m).alias("b"))))

    def drop(rows: Column) -> Column:
        # in a sorted array a form occurs often if it is equal to the one threshold - 1 places on
        forms = F.sort_array(F.transform(F.filter(rows, lambda s: s["b"] >= 5), lambda s: s["n"]))
        often = let(forms, lambda f: F.array_distinct(F.filter(f, lambda x, i: F.get(f, i + threshold - 1).eqNullSafe(x))))
        return let(often, lambda o: F.array_join(F.transform(F.filter(rows, lambda s: (s["b"] == 0) | ~F.array_contains(o, s["n"])), lambda s: s["x"]), "\n"))

    return let(each, drop)


def toc_lines(text: str) -> str:
    """Drop contents lines; after three of them everything up to a line of more than 60 bytes goes."""
    out, inside, streak = [], False, 0
    entry = re.compile(TOC_ENTRY)
    for line in rust_lines(text):
        m = line.strip()
        size = len(m.encode())
        if not m:
            if inside and streak >= 5:
                inside, streak = False, 0
            out.append(line)
        elif size < 80 and entry.match(m):
            streak += 1
            inside = inside or streak >= 3
        elif not inside or size > 60:
            inside, streak = False, 0
            out.append(line)
    return "\n".join(out)


def rust_lines(text: str) -> list[str]:
    parts = text.split("\n")
    if parts[-1] == "":
        parts.pop()
    return [p.removesuffix("\r") for p in parts]


def drop_toc(docs: DataFrame, column: str = "text") -> DataFrame:
    """``toc_lines`` on Arrow batches: the state runs from line to line."""
    at = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([None if t is None else toc_lines(t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def merge_breaks(t: Column) -> Column:
    """Join a line to the one before where that one was broken in mid-sentence, outside code and tables."""
    table = lambda x: x.rlike(r"^\|.*\|\z") | x.rlike(r"^\+[\-+]+\+\z")
    heading = r"(?U)^#{1,6}\s+"

    def join(rows: Column) -> Column:
        # fences from the second line on; their parity tells whether a line is in code
        fences = F.filter(F.transform(rows, lambda x, i: F.when((i > 0) & x["m"].startswith("```"), i).otherwise(-1)), lambda i: i > 0)

        def part(x: Column, i: Column, f: Column) -> Column:
            def joins(prev: Column) -> Column:
                cur = x["m"]
                code = F.size(F.filter(f, lambda k: k <= i)) % 2 == 1
                return (
                    (prev != "") & cur.rlike(rf"(?U)^[a-z{CJK}\d]") & ~prev.rlike(heading) & ~prev.rlike(SENTENCE_END) & ~code
                    & ~table(prev) & ~table(cur) & ((n_bytes(prev) < 120) | (n_bytes(cur) < 120))
                )

            return F.when(i == 0, x["raw"]).otherwise(F.concat(F.when(let(F.get(rows, i - 1)["m"], joins), " ").otherwise("\n"), x["raw"]))

        return let(fences, lambda f: F.array_join(F.transform(rows, lambda x, i: part(x, i, f)), ""))

    return let(F.transform(lines(t), lambda x: F.struct(x.alias("raw"), utrim(x).alias("m"))), join)


def collapse_blank(t: Column) -> Column:
    return F.regexp_replace(t, "\n{3,}", "\n\n")


def clean_text(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with ``column`` after all steps. The one step with a running state is an Arrow function between two projections."""
    first = docs.withColumn(column, drop_repeated(drop_watermarks(page_breaks(F.coalesce(F.col(column).cast("string"), F.lit(""))))))
    return drop_toc(first, column).withColumn(column, collapse_blank(merge_breaks(F.col(column))))
