"""Readers: mixed-encoding text files, HTML, file triage, prompts."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_BYTES = 500 * 1024 * 1024
TEXT, PDF, OTHER = ("md", "txt", "markdown", "rst", "org"), ("pdf",), ("docx", "doc", "html", "htm", "epub", "pptx", "xlsx", "csv", "json", "xml", "rtf")
LEGACY = ("shift_jis", "euc_kr", "gbk", "big5")
WIDE = re.compile("[一-鿿぀-ヿ가-힯]")


def decode_score(text: str) -> int:
    """CJK, kana and Hangul +10, ASCII letters and digits +1, controls -5, U+FFFD -10."""
    controls = sum(1 for c in text if (c < " " and c not in "\t\n\r") or "\x7f" <= c <= "\x9f")
    return 10 * len(WIDE.findall(text)) + len(re.findall("[A-Za-z0-9]", text)) - 5 * controls - 10 * text.count("�")


def decode(data: bytes) -> str:
    """UTF-8, else UTF-16 with a mark, else the best of four East Asian encodings (the first of equals), else Latin-1 without controls."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        try:
            return data.decode("utf-16")
        except UnicodeDecodeError:
            pass
    try:
        return data.decode("utf-8").removeprefix("﻿")
    except UnicodeDecodeError:
        pass
    best: tuple[int, str] | None = None
    for name in LEGACY:
        try:
            text = data.decode(name)
        except UnicodeDecodeError:
            continue
        if best is None or decode_score(text) > best[0]:
            best = (decode_score(text), text)
    return best[1] if best else re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f�]", " ", data.decode("latin-1"))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def kind(path: Column) -> Column:
    """text, pdf, other, or text for anything unknown."""
    s = suffix(path)
    return F.when(s.isin(*PDF), "pdf").when(s.isin(*OTHER), "other").otherwise("text")


def check_path(path: str) -> str:
    """``path`` if it is plain: neither a NUL nor a step up in it."""
    if not path or "\0" in path or ".." in re.split(r"[/\\]", path):
        raise ValueError(f"not an admissible path: {path!r}")
    return path


def files(spark: SparkSession, path: str, recursive: bool = False, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, modificationTime, length, content, kind, rejected) of a folder's files.

    A file of more than ``max_bytes`` has its row, with the reason in ``rejected`` and without content, which is never read.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(check_path(path))
    fits = df.where(F.col("length") <= max_bytes).withColumn("rejected", F.lit(None).cast("string"))
    large = df.select("path", "modificationTime", "length").where(F.col("length") > max_bytes).withColumn("content", F.lit(None).cast("binary"))
    large = large.withColumn("rejected", F.concat(F.lit("too large: "), F.col("length").cast("string"), F.lit(f" > {max_bytes} bytes")))
    return fits.unionByName(large).withColumn("kind", kind(F.col("path"))).select("path", "modificationTime", "length", "content", "kind", "rejected")


def decoded(df: DataFrame, column: str = "content") -> DataFrame:
    """(path, text) from binary content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else decode(x) for x in b.column(1).to_pylist()], pa.string())], names=["path", "text"])

    return df.select("path", column).mapInArrow(run, "path string, text string")


def read_text(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    return decoded(files(spark, path, recursive).where("kind = 'text' and rejected is null"))


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of a folder of Markdown prompts."""
    return spark.read.option("wholetext", True).option("pathGlobFilter", "*.md").text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1).alias("name"), F.col("value").alias("text"))


DROP = re.compile(r"<!--.*?-->|<(script|style|head)\b.*?</\1\s*>", re.S | re.I)


def html_markdown(page: str) -> str:
    """A page's headings, paragraphs, list items and table rows as Markdown lines."""
    page = DROP.sub("", page)
    page = re.sub(r"<h([1-6])\b[^>]*>", lambda m: "\n\n" + "#" * int(m[1]) + " ", page, flags=re.I)
    page = re.sub(r"<li\b[^>]*>", "\n- ", page, flags=re.I)
    page = re.sub(r"</t[dh]\s*>\s*<t[dh]\b[^>]*>", " | ", page, flags=re.I)
    page = re.sub(r"<(p|div|section|article|tr|table|ul|ol|blockquote|br|nav|footer|header)\b[^>]*>|</(p|div|h[1-6]|li|tr|table|nav|article|footer|header|ul|ol)\s*>", "\n", page, flags=re.I)
    text = html.unescape(re.sub(r"<[^>]*>", "", page))
    rows = [" ".join(x.split()) for x in text.split("\n")]
    return "\n".join(x for x in rows if x and x not in ("-", "#"))


def html_to_markdown(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([html_markdown(x or "") for x in b.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return pages.select(F.col(key).cast("long"), F.col(column).cast("string")).mapInArrow(run, f"{key} long, text string")


def pdf_facts(data: bytes) -> tuple[int, int, int, int]:
    """(pages, fonts, images, objects) counted in a PDF's bytes; compressed object streams hide theirs."""
    return (len(re.findall(rb"/Type\s*/Page\b", data)), len(re.findall(rb"/Type\s*/Font\b", data)), len(re.findall(rb"/Subtype\s*/Image\b", data)), len(re.findall(rb"\d+\s+\d+\s+obj\b", data)))


def triage(facts: DataFrame) -> DataFrame:
    """``facts(path, pages, fonts, images, objects)`` with status and confidence."""
    status = F.when(F.col("fonts") > 0, "HasText").when((F.col("images") == 0) & (F.col("objects") > 20 * F.col("pages")), "HandDrawn").otherwise("NeedOcr")
    d = facts.withColumn("status", status)
    return d.withColumn("confidence", F.when(F.col("pages") == 0, 0).when(F.col("status") == "HasText", F.when(F.col("fonts") >= 3, 95).otherwise(80)).when(F.col("status") == "NeedOcr", 90).otherwise(75))


def scan(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Triage of all PDF files under a folder; one row a file, in parallel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [pdf_facts(x or b"") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (zip(*got) if got else [[]] * 4))], names=["path", "pages", "fonts", "images", "objects"])

    pdf = files(spark, path, recursive).where("kind = 'pdf' and rejected is null").select("path", "content")
    return triage(pdf.mapInArrow(run, "path string, pages long, fonts long, images long, objects long"))


def scan_report(scanned: DataFrame) -> DataFrame:
    """Files and share by status."""
    counts = scanned.groupBy("status").agg(F.count("*").alias("n"))  # three rows at most
    return counts.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def scan_quality(status: Column, pages: Column, fonts: Column, images: Column) -> Column:
    """struct<overall, text_layer, structure, image_quality>: fixed bands by status; overall is the integer mean where the parts vary."""
    full, ocr, drawn = status == "HasText", status == "NeedOcr", status == "HandDrawn"
    layer = F.when(full, F.when(fonts >= 3, 95).when(fonts >= 2, 85).when(fonts >= 1, 75).otherwise(60)).when(ocr, 20).when(drawn, 15).otherwise(0)
    shape = F.when(full, F.when((fonts >= 2) & (pages > 1), 90).when(fonts >= 1, 80).otherwise(65)).when(ocr, 30).when(drawn, 25).otherwise(0)
    band = lambda none, few, many: F.when(images == 0, none).when(images <= 2, few).otherwise(many)
    image = F.when(full, band(95, 85, 70)).when(ocr, band(60, 50, 35)).when(drawn, 50).otherwise(0)
    overall = F.when(full | ocr, F.floor((layer + shape + image) / 3)).when(drawn, 30).otherwise(0)
    return F.struct(overall.cast("int").alias("overall"), layer.alias("text_layer"), shape.alias("structure"), image.alias("image_quality"))


def quality_label(score: Column) -> Column:
    return F.when(score >= 80, "优").when(score >= 60, "良").when(score >= 40, "中").otherwise("差")


def text_density(chars: Column, sampled_pages: Column) -> Column:
    """Characters a sampled page."""
    return chars / F.greatest(sampled_pages, F.lit(1))


def likely_scanned(path: Column, length: Column) -> Column:
    """A PDF of more than 2 MB is taken for a scan."""
    return (suffix(path) == "pdf") & (length > 2 * 1024 * 1024)


def looks_like_page_marker(c: Column) -> Column:
    """Whether a title read from a file is a page marker: blank, a heading, a page or chapter number, digits only, or under three characters."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+\z", "")
    return (t == "") | t.startswith("#") | t.rlike(r"第\s*[0-9一二三四五六七八九十百零]+\s*[页章]") | t.rlike(r"(?i)^(page|chapter)\s*\d+") | t.rlike(r"^[0-9]+\z") | (F.length(t) < 3)
