"""Markdown and Mermaid rendering as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, lines, text
from .lint import TYPE_LABELS


def escape(c: Column) -> Column:
    """``---`` gets a backslash, and so does a line that begins with # or >."""
    return F.array_join(F.transform(lines(F.replace(c, F.lit("---"), F.lit("\\---"))), lambda x: F.when(x.rlike(r"(?U)^\s*[#>]"), F.concat(F.lit("\\"), x)).otherwise(x)), "\n")


def type_label(c: Column) -> Column:
    out = F.lit(TYPE_LABELS["Knowledge"])
    for code, label in TYPE_LABELS.items():
        out = F.when(c == code, label).otherwise(out)
    return out


def card_markdown(cards: DataFrame) -> Column:
    """A card in Markdown: heading with its type, title, body, reference, trace, id, rule. Missing columns count as empty."""
    c = {n: text(n) if n in cards.columns else F.lit("") for n in "title content card_type reference unique_id original_text source paraphrase source_file chunk_id location evidence status reject_reason".split()}
    score = F.coalesce(F.col("quality_score"), F.lit(1.0)) if "quality_score" in cards.columns else F.lit(1.0)
    status = F.when(c["status"] == "", "Accepted").otherwise(c["status"])
    related = F.coalesce(F.col("related_cards"), F.array().cast("array<string>")) if "related_cards" in cards.columns else F.array().cast("array<string>")

    def part(label: str, value: Column, on: Column) -> Column:
        return F.when(on, F.array(F.concat(F.lit(f"**{label}：** "), value), F.lit(""))).otherwise(F.array().cast("array<string>"))

    filled = lambda n, label: part(label, escape(c[n]), c[n] != "")
    title = part("标题", escape(c["title"]), F.lit(True))
    ref = filled("reference", "ref")
    place = F.concat_ws(" / ", F.when(c["chunk_id"] != "", F.concat(F.lit("chunk "), c["chunk_id"])), F.when(c["location"] != "", c["location"]))
    trace = F.concat(
        part("来源文件", c["source_file"], c["source_file"] != ""), part("位置", place, place != ""), part("证据", c["evidence"], c["evidence"] != ""),
        part("质量", F.concat(F.format_string("%.0f", score * 100), F.lit("% / "), status), (score < 1) | (status != "Accepted")), part("处理原因", c["reject_reason"], c["reject_reason"] != ""),
        part("uuid", c["unique_id"], c["unique_id"] != ""), F.array(F.lit("***"), F.lit("")),
    )
    links = F.concat(F.transform(related, lambda r: F.concat(F.lit("> 关联卡片：「"), r, F.lit("」"))), F.when(F.size(related) > 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
    own = F.when((c["content"] != "") & (c["content"] != c["original_text"]), F.array(escape(c["content"]), F.lit(""))).otherwise(F.array().cast("array<string>"))
    quote = F.concat(title, filled("original_text", "原文"), filled("source", "出处"), filled("paraphrase", "仿写"), own, links, ref, trace)
    plain = F.concat(title, F.array(escape(c["content"]), F.lit("")), ref, trace)
    head = F.array(F.concat(F.lit("# "), type_label(c["card_type"])), F.lit(""))
    return F.array_join(F.concat(head, F.when(c["card_type"] == "Quote", quote).otherwise(plain)), "\n")


def mermaid_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit('"'), F.lit("'")), F.lit("#"), F.lit("\\#")), F.lit("\n"), F.lit(" "))


def mermaid(relations: DataFrame) -> DataFrame:
    """(line) rows of a Mermaid graph: nodes numbered by name, then one edge per relation."""
    names = relations.select(F.explode(F.array("source", "target")).alias("name")).distinct()
    nodes = names.withColumn("id", F.row_number().over(Window.orderBy("name")) - 1)  # distinct names of one drawing
    a, b = nodes.select(F.col("name").alias("source"), F.col("id").alias("i")), nodes.select(F.col("name").alias("target"), F.col("id").alias("j"))
    edges = relations.join(a, "source").join(b, "target").select(F.concat(F.lit("    N"), F.col("i"), F.lit(" -->|"), mermaid_escape(F.col("relation_type")), F.lit("| N"), F.col("j")).alias("line"))
    return nodes.select(F.concat(F.lit("    N"), F.col("id"), F.lit('["'), mermaid_escape(F.col("name")), F.lit('"]')).alias("line")).unionByName(edges)


def file_name(c: Column) -> Column:
    """Fourteen characters that file names must not have become underscores."""
    return F.trim(F.translate(c, '/\\:*?"<>|：？＜＞｜', "_" * 14))


def guess_title(t: Column, stem: Column) -> Column:
    """The first heading of level one or two in the first ten lines, else the file's stem, else a placeholder."""
    head = F.filter(F.slice(lines(t), 1, 10), lambda x: x.rlike(r"(?U)^\s*##?\s+\S"))
    return let(F.get(head, F.lit(0)), lambda h: F.coalesce(F.regexp_replace(h, r"(?U)^\s*##?\s+|\s+\z", ""), F.when(stem != "", stem), F.lit("未命名")))


def split_before_h1(t: Column) -> Column:
    return F.regexp_replace(t, r"\n(?=#[^\S\n])", "\n\n")
