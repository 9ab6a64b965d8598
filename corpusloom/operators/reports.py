"""Markdown reports: entities, chunks, diagnostics, summaries and input quality, one text per group or row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text


def _listed(rows: DataFrame, keys: list[str], order: str, line: Column, title: str) -> DataFrame:
    """(keys, markdown): the lines of each group in ``order`` under a title. A report is one text, so a group must fit a document."""
    d = rows.select(*keys, F.col(order).alias("_o"), line.alias("_l")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_o", "_l"))).alias("_a"))
    return d.select(*keys, F.array_join(F.concat(F.array(F.lit(title)), F.transform("_a", lambda x: x["_l"])), "\n").alias("markdown"))


def entities_markdown(entities: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """One list per group of ``entities(name, entity_type, context)``; an empty context is left out."""
    context = F.when(text("context") != "", F.concat(F.lit(" — "), text("context"))).otherwise("")
    return _listed(entities, keys, order, F.concat(F.lit("- **"), text("name"), F.lit("** ("), text("entity_type"), F.lit(")"), context), "# 实体列表\n")


def chunks_markdown(chunks: DataFrame, keys: list[str], order: str = "chunk_idx") -> DataFrame:
    """One list per group of ``chunks(title_path, size, entities, cards, relations)``, numbered from 1."""
    count = lambda name, unit, c: F.concat(F.lit(f"\n- {name}: "), F.coalesce(F.col(c), F.lit(0)).cast("string"), F.lit(unit))
    body = F.concat(text("title_path"), count("大小", " 字符", "size"), count("实体", "", "entities"), count("卡片", "", "cards"), count("关系", "", "relations"), F.lit("\n"))
    d = chunks.select(*keys, F.col(order).alias("_o"), body.alias("_l")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_o", "_l"))).alias("_a"))
    lines = F.transform("_a", lambda x, i: F.concat(F.lit("## 块 "), (i + 1).cast("string"), F.lit(": "), x["_l"]))
    return d.select(*keys, F.array_join(F.concat(F.array(F.lit("# 分块信息\n")), lines), "\n").alias("markdown"))


def diagnostics_markdown(diag: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """One report per group of ``diag(diag_type, stage, message, retry_count, final_status, expected_count, actual_count, success)``.

    Types are fail, degradation and retry; a group whose rows have no type reports that nothing went wrong.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    stage = F.concat(F.lit("- **阶段**: "), text("stage"))
    fail = F.concat(stage, F.lit("  - **错误**: "), text("message"), F.lit("  - **重试次数**: "), n("retry_count"), F.lit("  - **最终状态**: "), text("final_status"), F.lit("\n"))
    less = F.concat(stage, F.lit("  - **原因**: "), text("message"), F.lit("  - **预期产出**: "), n("expected_count"), F.lit(" 个 / **实际产出**: "), n("actual_count"), F.lit(" 个\n"))
    result = F.when(F.coalesce("success", F.lit(False)), "✓ 成功").otherwise("✗ 失败")
    again = F.concat(stage, F.lit(" | **重试次数**: "), n("retry_count"), F.lit(" | **结果**: "), result, F.lit("\n"))
    kind = F.col("diag_type")
    rank = F.when(kind == "fail", 0).when(kind == "degradation", 1).when(kind == "retry", 2)
    line = F.when(kind == "fail", fail).when(kind == "degradation", less).when(kind == "retry", again)
    d = diag.select(*keys, rank.alias("_t"), F.col(order).alias("_o"), line.alias("_l")).groupBy(*keys)
    d = d.agg(F.array_sort(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct("_t", "_o", "_l")))).alias("_a"))

    def part(t: int, title: str) -> Column:
        mine = F.filter("_a", lambda x: x["_t"] == t)
        return F.when(F.size(mine) > 0, F.concat(F.lit(f"\n## {title}\n"), F.array_join(F.transform(mine, lambda x: x["_l"]), ""))).otherwise("")

    fine = F.when(F.size("_a") == 0, "\n✓ 编译过程无异常，所有阶段正常完成。\n").otherwise("")
    return d.select(*keys, F.concat(F.lit("# 编译诊断报告\n"), part(0, "❌ 失败阶段"), part(1, "⚠️ 降级阶段"), part(2, "🔄 重试结果"), fine).alias("markdown"))


def summary_markdown(title: Column, overview: Column, points: Column, structure: Column) -> Column:
    """A summary with numbered key points."""
    numbered = F.transform(F.coalesce(points, F.array().cast("array<string>")), lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), p))
    head = F.array(F.concat(F.lit("# "), text(title), F.lit(" — 核心摘要")), F.lit(""), F.lit("## 概述"), F.lit(""), text(overview), F.lit(""), F.lit("## 核心要点"), F.lit(""))
    return F.array_join(F.concat(head, numbered, F.array(F.lit(""), F.lit("## 结构"), F.lit(""), text(structure), F.lit(""))), "\n")


def input_quality_markdown(source: Column, grade: Column, overall: Column, acceptable: Column, issues: Column, scan: Column | None = None) -> Column:
    """The input quality report of a row; ``scan`` is a struct (pages, sampled_pages, text_density, requires_ocr, confidence, detection_method, reason) or null."""
    yes = lambda c: F.when(c, "是").otherwise("否")
    out = F.concat(F.lit("# 输入质量报告\n\n- 来源文件："), text(source), F.lit("\n- 综合等级："), grade, F.format_string("\n- 综合评分：%.1f/100", overall), F.lit("\n- 是否允许进入编译："), yes(acceptable), F.lit("\n"))
    if scan is not None:
        f = scan.getField
        found = F.concat(
            F.lit("\n## PDF 探测\n\n- 页数："), f("pages").cast("string"), F.lit("\n- 抽样页数："), f("sampled_pages").cast("string"), F.format_string("\n- 文本密度：%.1f 字/页", f("text_density")),
            F.lit("\n- 需要 OCR："), yes(f("requires_ocr")), F.lit("\n- 置信度："), f("confidence").cast("string"), F.lit("%\n- 探测方法："), text(f("detection_method")), F.lit("\n- 判断原因："), text(f("reason")), F.lit("\n"),
        )
        out = F.concat(out, F.when(scan.isNotNull(), found).otherwise(""))
    listed = F.concat(F.lit("\n## 关键问题\n\n"), F.array_join(F.transform(issues, lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), ""))
    return F.concat(out, F.when(F.size(F.coalesce(issues, F.array().cast("array<string>"))) > 0, listed).otherwise(""))


def score_bar(score: Column) -> Column:
    """Ten blocks, one filled for each full ten points."""
    filled = F.least(F.floor(F.greatest(score, F.lit(0)) / 10), F.lit(10)).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), 10 - filled), F.lit("]"))
