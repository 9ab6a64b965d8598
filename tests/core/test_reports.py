import pytest
from pyspark.sql import functions as F

from corpusloom.operators import history, lint, planner, reports
from corpusloom.plans import llm_stage
from corpusloom.sources import readers


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_lists(spark):
    e = spark.createDataFrame([(1, 2, "乙", "人", ""), (1, 1, "甲", "书", "某处"), (2, 1, None, "t", None)], "g int, pos int, name string, entity_type string, context string")
    got = {r.g: r.markdown for r in reports.entities_markdown(e, ["g"]).collect()}
    assert got == {1: "# 实体列表\n\n- **甲** (书) — 某处\n- **乙** (人)", 2: "# 实体列表\n\n- **** (t)"}
    c = spark.createDataFrame([(1, 1, "b", 5, 1, 2, 3), (1, 0, "a", 4, None, 0, 0)], "g int, chunk_idx int, title_path string, size long, entities long, cards long, relations long")
    assert reports.chunks_markdown(c, ["g"]).first().markdown == "# 分块信息\n\n## 块 1: a\n- 大小: 4 字符\n- 实体: 0\n- 卡片: 0\n- 关系: 0\n\n## 块 2: b\n- 大小: 5 字符\n- 实体: 1\n- 卡片: 2\n- 关系: 3\n"


def test_diagnostics(spark):
    d = spark.createDataFrame([(1, 1, "retry", "s", None, 2, None, None, None, True), (1, 2, "fail", "t", "e", 1, "gone", None, None, None), (1, 3, "degradation", "u", "r", None, None, 5, 3, None), (2, 1, None, None, None, None, None, None, None, None)], "g int, pos int, diag_type string, stage string, message string, retry_count int, final_status string, expected_count int, actual_count int, success boolean")
    got = {r.g: r.markdown for r in reports.diagnostics_markdown(d, ["g"]).collect()}
    assert got[1] == "# 编译诊断报告\n\n## ❌ 失败阶段\n- **阶段**: t  - **错误**: e  - **重试次数**: 1  - **最终状态**: gone\n\n## ⚠️ 降级阶段\n- **阶段**: u  - **原因**: r  - **预期产出**: 5 个 / **实际产出**: 3 个\n\n## 🔄 重试结果\n- **阶段**: s | **重试次数**: 2 | **结果**: ✓ 成功\n"
    assert got[2] == "# 编译诊断报告\n\n✓ 编译过程无异常，所有阶段正常完成。\n"


def test_texts(spark):
    lit = F.lit
    assert one(spark, reports.summary_markdown(lit("T"), lit("o"), F.array(lit("a"), lit("b")), lit("s"))) == "# T — 核心摘要\n\n## 概述\n\no\n\n## 核心要点\n\n1. a\n2. b\n\n## 结构\n\ns\n"
    plain = one(spark, reports.input_quality_markdown(lit("f.md"), lit("B"), lit(81.25), lit(True), F.array(lit("x"))))
    assert plain == "# 输入质量报告\n\n- 来源文件：f.md\n- 综合等级：B\n- 综合评分：81.3/100\n- 是否允许进入编译：是\n\n## 关键问题\n\n- x\n"
    assert [one(spark, reports.score_bar(lit(x))) for x in (0, 55, 100)] == ["[" + "█" * n + "░" * (10 - n) + "]" for n in (0, 5, 10)]
    assert one(spark, planner.doc_limits(lit(100_000))).entity_output == 5000 and one(spark, planner.doc_limits(lit(0))).card_output == 3000
    assert one(spark, planner.prompt_name(lit("Quote"))) == "quote_card" and one(spark, planner.prompt_name(lit("x"))) is None
    assert [one(spark, readers.looks_like_page_marker(lit(x))) for x in (" ", "# a", "第 3 页", "Chapter 4", "007", "ab", "聪明的阅读者")] == [True] * 6 + [False]
    assert tuple(one(spark, readers.scan_quality(lit("HasText"), lit(2), lit(3), lit(0)))) == (93, 95, 90, 95)
    assert tuple(one(spark, readers.scan_quality(lit("NeedOcr"), lit(2), lit(0), lit(3)))) == (28, 20, 30, 35)
    assert [one(spark, readers.quality_label(lit(x))) for x in (80, 60, 40, 39)] == ["优", "良", "中", "差"]
    with pytest.raises(ValueError):
        readers.check_path("a/../b")


def test_reference_by_page(spark):
    source = "聪明的阅读者\n## 第 4 页\n费孝通 乡土人生\n" + "字" * 400 + "## 第 9 页\n核心概念在此"
    rows = [("阳志平《乡土人生》全书", "t", "乡土人生_p4"), ("费孝通_1947_系列", "t", "聪明的阅读者_p4"), ("乡土人生（费孝通，1947）", "t", "聪明的阅读者_p4"), ("Dunbar 1992", "没有，核心概念", "聪明的阅读者_p9"), ("Dunbar 1992", "没有", "Dunbar 1992"), ("", "核心概念", ""), ("某书_第3页", "核心概念", "某书_p3")]
    df = spark.createDataFrame([(*r, source) for r in rows], "reference string, title string, want string, s string")
    got = df.select("want", lint.repair_ref_by_page(F.col("reference"), F.col("title"), F.col("s"), ["人生模式", "聪明的阅读者"]).alias("x")).collect()
    assert [r.x for r in got] == [r.want for r in got]
    ask = lambda e, s, st: one(spark, lint.evidence_issue(F.lit(e), F.lit(s), F.lit(st)))
    assert [ask("a", "bab", "Accepted"), ask(" ", "x", "Accepted"), ask("q", "x", "Accepted"), ask("q", "", "Accepted"), ask("", "x", "Rejected")] == [None, "MissingEvidence", "EvidenceNotFound", None, None]
    cards = spark.createDataFrame([("标题机制", "标题机制的内容：首先分析机制与原理，其次总结概念与模型，最后得出明确的结论和重要意义。", "Knowledge", "某书_第3页", "", "")], "title string, content string, card_type string, reference string, original_text string, source string")
    valid, stats = lint.filter_cards(cards, [])
    assert [r.reference for r in valid.collect()] == ["某书_p3"] and stats.where("code = 'InvalidRefFormat'").count() == 0


def test_history_children(spark, tmp_path):
    path = str(tmp_path / "h")
    cards = spark.createDataFrame([(7, "20240102030405", "t", "Accepted", ""), (7, "x", "u", "Rejected", "r"), (8, "", "v", "Accepted", "")], "compilation_id long, unique_id string, title string, status string, reject_reason string")
    chunks = spark.createDataFrame([(7, 0, "p", 10)], "compilation_id long, chunk_index long, title_path string, char_count long")
    runs = spark.createDataFrame([(7, 1, "2024-01-01"), (8, 1, "2024-01-02"), (9, 2, "2024-01-03")], "id long, book_id long, compiled_at string")
    got = {r.id: r for r in history.record_compilations(path, runs, {"cards": cards, "chunks": chunks}).collect()}
    assert [(got[i].version, got[i].total_cards, got[i].accepted_cards, got[i].reviewed) for i in (7, 8, 9)] == [(1, 2, 1, 0), (2, 1, 1, 0), (1, 0, 0, 0)]
    assert sorted(r.created_at for r in spark.read.parquet(f"{path}/cards").collect()) == ["", "", "2024-01-02 03:04:05"]
    more = history.record_compilations(path, spark.createDataFrame([(10, 1, "2024-02-01")], runs.schema), {"cards": cards.limit(0)})
    assert more.first().version == 3 and spark.read.parquet(f"{path}/compilations").count() == 4
    books = spark.createDataFrame([(1, "a", 0, "x"), (2, "b", 0, "y")], "id long, title string, last_success int, last_compiled_at string")
    out = spark.createDataFrame([(1, False, "2024-01-01"), (1, True, "2024-01-02")], "book_id long, success boolean, at string")
    assert sorted(map(tuple, history.update_status(books, out).collect())) == [(1, "a", 1, "2024-01-02"), (2, "b", 0, "y")]


def test_answers(spark, tmp_path):
    raw = spark.createDataFrame([(1, '{"cards":[{"card_type":"金句卡","title":"a"},{"card_type":"?","title":"b"}]}')], "doc_id long, raw string")
    assert [(r.title, r.card_type) for r in llm_stage.parse_unified(raw).collect()] == [("a", "Quote"), ("b", "Knowledge")]

    class Odd:
        def __init__(self, answers):
            self.answers = iter(answers)

        def call_json(self, prompt):
            got = next(self.answers)
            if isinstance(got, Exception):
                raise got
            return got

    assert llm_stage.Patient(Odd(["{}", ConnectionError(), "[1]"]), wait=0).call_json("p") == "[1]"
    with pytest.raises(RuntimeError):
        llm_stage.Patient(Odd([" "] * 3), wait=0).call_json("p")
    path = str(tmp_path / "cache")
    chunks = spark.createDataFrame([(1, 0, "doc", "r")], "doc_id long, chunk_idx int, document string, raw string")
    llm_stage.cache_write(chunks, path, "p", "m")
    cache = spark.read.parquet(path)
    assert [r.raw for r in llm_stage.cache_read(cache, chunks, "p", "m").collect()] == ["r"] and llm_stage.cache_read(cache, chunks, "p", "n").count() == 0
    assert llm_stage.cache_evicted(cache).count() == 1 and llm_stage.cache_evicted(cache, sets=0).count() == 0
    old = cache.withColumn("at", F.col("at") - F.expr("interval 31 days"))
    assert llm_stage.cache_evicted(old).count() == 0
