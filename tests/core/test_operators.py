import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import chunk, classify, clean, dedup, entities, grid, history, lint, pages, planner, quality, render, similarity, typo
from corpusloom.plans import compile as plan
from corpusloom.plans import llm_stage
from corpusloom.sources import readers, sinks
from corpusloom.streaming import ingest


def col(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


# cleaning
@pytest.mark.parametrize(
    "f,given,want",
    [
        (clean.page_breaks, "段落A\f段落B\f\f段落C", "段落A\n\n段落B\n\n段落C"),
        (clean.drop_watermarks, "内容A\n本书由「ePUBw.COM」整理\n电子书下载！！！\n访问 epubw.com\n内容B", "内容A\n内容B"),
        (clean.drop_watermarks, "文本A https://github.com/a/b 文本B", "文本A https://github.com/a/b 文本B"),
        (lambda c: clean.drop_repeated(c, 3), "页脚内容 15\n正文A\n页脚内容 16\n正文B\n页脚内容 17\n正文C\n页脚内容 18\n页脚内容 19", "正文A\n正文B\n正文C"),
        (clean.merge_breaks, "文本A被强制\n换行的文本B。\n\n文本C。", "文本A被强制 换行的文本B。\n\n文本C。"),
        (clean.merge_breaks, "This is a sentence\nthat was broken\nmidway.\nNew one", "This is a sentence that was broken midway.\nNew one"),
        (clean.merge_breaks, "a\n```\nb\nc\n```\n\nd", "a\n```\nb\nc\n```\n\nd"),
        (clean.merge_breaks, "# head\nbody\n|a|\n|b|", "# head\nbody\n|a|\n|b|"),
        (clean.collapse_blank, "a\n\n\n\nb", "a\n\nb"),
        (clean.drop_watermarks, "", ""),
        (clean.merge_breaks, "", ""),
    ],
)
def test_cleaning(spark, f, given, want):
    assert col(spark, given, f) == want


def test_toc():
    assert clean.toc_lines("前言\n\n第1章 标题\n1.1 小节\n1.2 小节\n短行\n" + "正文" * 20) == "\n" + "正文" * 20
    assert clean.toc_lines("文本A章节C文本B。\n文本D。") == "文本A章节C文本B。\n文本D。"


def test_line_helpers_equal_plain_python(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab \n\r\t é知") for _ in range(rnd.randint(0, 30))).replace("\r", "\r\n") for _ in range(80)] + ["", "\n", "a\n", "\n\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", X.lines(F.col("t")).alias("l"), X.utrim(F.col("t")).alias("u")).collect():
        assert r.l == clean.rust_lines(texts[r.i])
        assert r.u == texts[r.i].strip()


# quality, classification, planning
def test_quality_of_edge_texts(spark):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "x", 9)], "doc_id long, text string, chars int")
    got = {r.doc_id: r for r in quality.report(df).where("overall >= 0").collect()}
    assert got[1].grade == got[2].grade == "F" and got[1].chars.garbled_ratio == 1.0 and got[3].chars.score == 100.0
    assert quality.report(df.limit(0)).count() == 0


def test_issues_print_shares_as_sql_does(spark):
    rnd = random.Random(2)
    values = [31.25, 18.75, 6.25, 0.25, 0.35, 1.05, 7.25, 99.95, 0.0, 100.0, (1 - 64 / 69) * 100] + [rnd.randint(0, 1600) / 16 for _ in range(300)] + [(1 - rnd.randint(1, 80) / 80) * 100 for _ in range(300)] + [rnd.randint(0, 20000) / 200 for _ in range(300)]
    for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", X.one_decimal(F.col("v")).alias("s")).collect():
        assert r.s == "%.1f" % r.v
    # exactly one of 20 characters: 1 - 19 / 20 is over 0.05; one of 16 is a true tie
    df = spark.createDataFrame([(1, "x" * 19 + "é"), (2, "x" * 15 + "é"), (3, "x" * 20 + "é")], "doc_id long, text string")
    got = {r.doc_id: r.issues for r in quality.report(df).collect()}
    assert got == {1: ["乱码比例过高: 5.0%"], 2: ["乱码比例过高: 6.2%"], 3: []}


@pytest.mark.parametrize("given,want", [("", "Unknown"), ("文本A", "Article"), ("内容O。" * 100, "Article"), ("# t\n摘要 x\n关键词 y\n参考文献 z", "Paper"), ("```x```\n步骤 1\n步骤 2", "Manual")])
def test_doc_type(spark, given, want):
    assert classify.classify(spark.createDataFrame([(given,)], "text string")).first().doc_type == want


def test_planner(spark):
    lim = lambda a, b: spark.range(1).select(planner.chunk_limit(F.lit(a), F.lit(b))).first()[0]
    assert lim(0, 0) == 10_000 and lim(128_000, 8192) == 46811 and lim(10**7, 10**7) == 500_000
    df = spark.createDataFrame([(1, 0, 1), (2, 436_320, 9)], "doc_id long, chars long, chunks long")
    got = {(r.doc_id, r.card_type): r.target for r in planner.type_targets(df, "chars", "chunks").collect()}
    assert got[1, "Term"] == 0 and got[2, "Term"] == 2 and got[2, "Review"] == 1


# lint
BASE = {"title": "标题A", "content": "内容A" * 10 + "。标题A。", "card_type": "Knowledge", "reference": "测试文档_p23", "original_text": "", "source": ""}


def codes(spark, **change):
    r = lint.lint(spark.createDataFrame([tuple((BASE | change).values())], "title string, content string, card_type string, reference string, original_text string, source string")).first()
    return {i.code for i in r.issues}, r


def test_lint(spark):
    assert codes(spark)[0] <= {"LowInfoDensity"} and codes(spark)[1].is_valid
    assert "EmptyTitle" in codes(spark, title="")[0] and not codes(spark, title=None)[1].is_valid
    assert "EmptyOrShortContent" in codes(spark, content="短")[0]
    assert "HighGarbageRatio" in codes(spark, content="�" * 5 + "内容A")[0]
    assert "TitleContentMismatch" in codes(spark, title="标题X啊", content="完全不同" * 10)[0]
    assert "ReferenceMismatch" in codes(spark, card_type="Quote", original_text="原文")[0]
    assert "LikelyCopied" in codes(spark, original_text=BASE["content"])[0]
    assert "TypeConfusion" in codes(spark, card_type="Term", title="反常识卡——什么是反常识")[0]
    assert codes(spark, card_type="Action", content="x" * 40, title="xx")[1].status == "Accepted"


@pytest.mark.parametrize("ref,ok", [("人生模式_p7", True), ("Result_20_p15", True), ("人生模式_p172-173", True), ("", False), ("文档第236页", False), ("人生模式_p", False), ("作者简介", False), ("人生模式_abc", False), ("George A.Kelly_p3", False), ("[美]某_p1", False)])
def test_ref(spark, ref, ok):
    assert col(spark, ref, lint.ref_ok) == ok


@pytest.mark.parametrize("ref,want", [("书_第12-13页", "书_p12"), ("本书第5页", "人生模式_p5"), ("《书》, p.7", "书_p7"), ("书_p.9", "书_p9"), ("作者《书名》_p3", "书名_p3"), ("书_p１２", "书_p12")])
def test_ref_repair(spark, ref, want):
    assert col(spark, ref, lambda c: lint.repair_ref(c, F.lit("来自人生模式"), ["人生模式"])) == want


def test_page_search(spark):
    src = "## 第 1 页\n甲\n" + "字" * 400 + "\n## 第 2 页\n乙在此\n"
    assert col(spark, src, lambda c: lint.page_of(c, F.lit("乙在此"), 100)) == "2"
    assert col(spark, src, lambda c: lint.page_of(c, F.lit("没有"))) is None


@pytest.mark.parametrize("a,b,want", [("abababab", "aaaabbbb", 5 / 8), ("认知负荷理论", "认知负荷理论指出", 0.75), ("x", "x", 1.0), ("", "x", 0.0)])
def test_lcs(a, b, want):
    assert similarity._ratio(a, b) == pytest.approx(want)


def test_lcs_equals_table():
    rnd = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 12))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert similarity.lcs_length(a, b) == t[-1][-1]


def test_fnv(spark):
    assert col(spark, "a", similarity.fnv1a) == "af63dc4c8601ec8c" and col(spark, "", similarity.fnv1a) == "cbf29ce484222325"


# dedup
def _cards(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos long, title string, content string, reference string, card_type string")


def test_similarity_join_equals_all_pairs(spark):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcdefgh") for _ in range(60)) for _ in range(6)]
    rows = []
    for _ in range(60):
        t = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 12)):
            t[rnd.randrange(60)] = rnd.choice("abcdefgh")
        rows.append((rnd.choice(["one", "two"]), "".join(t), "r_p1", "Term"))
    rows += [rows[0], ("", "", "", "Term"), (None, None, None, "Term")]
    c = _cards(spark, rows)
    sh = lambda t, k=2: {t[i : i + k] for i in range(len(t) - k + 1)} if len(t) >= k else {t}
    j = lambda a, b: len(a & b) / len(a | b)
    for threshold in (0.45, 0.65):
        first = {}
        for i, r in enumerate(rows):
            first.setdefault((r[0] or "", r[1] or ""), i)
        reps = list(first.items())
        want = {}
        for n, ((t, x), i) in enumerate(reps):
            for (u, y), k in reps[n + 1 :]:
                s = 0.3 * j(sh(t), sh(u)) + 0.7 * j(sh(x), sh(y))
                if s >= threshold:
                    want[i, k] = round(s, 9)
        edges = dedup.similarity_edges(c, 2, threshold)
        assert {(e.a, e.b): round(e.sim, 9) for e in edges.collect()} == want
        comp = {r.pos: r.component for r in dedup.members(c, edges).collect()}
        assert len(comp) == len(rows) and comp[60] == comp[0]


def test_repeated_pos_and_hot_shingles(spark):
    """Rows count by themselves: a repeated pos neither multiplies nor loses rows."""
    body = "机制原理规律概念定义术语范式假设推论认知" * 6
    c = spark.createDataFrame([(1, "标题", body, "", "Knowledge")] * 2 + [(1, "别的", "完全不同的一段内容" * 8, "", "Knowledge"), (2, "标题", body + "！", "", "Knowledge")], "pos long, title string, content string, reference string, card_type string")
    assert sorted((r.pos, r.merged) for r in dedup.dedup_cards(c).collect()) == [(1, 1), (2, 3)]
    rows = [(i, "t" * (3 + i % 4), "共有的开头文字" * 3 + "".join(chr(0x4E00 + (i * 37 + j * j) % 300) for j in range(i % 12))) for i in range(120)]
    df = spark.createDataFrame(rows, "pos long, title string, content string")
    sh = lambda t: {t[i : i + 2] for i in range(len(t) - 1)} if len(t) >= 2 else {t}
    jac = lambda a, b: len(a & b) / len(a | b)
    reps = {}
    for i, t, x in rows:
        reps.setdefault((t, x), i)
    want = {(i, j): 0.3 * jac(sh(t), sh(u)) + 0.7 * jac(sh(x), sh(y)) for (t, x), i in reps.items() for (u, y), j in reps.items() if i < j}
    for threshold in (0.45, 0.65, 0.9):
        got = {(r.a, r.b): r.sim for r in dedup.similarity_edges(df, 2, threshold).collect()}
        assert got == pytest.approx({k: v for k, v in want.items() if v >= threshold}) and got


def _alike_texts(n: int) -> list[tuple]:
    rnd = random.Random(3)
    out = [(7, "one", ""), (8, "", ""), (9, "two", "a"), (10, "two", "\0\0"), (11, "two", "知识𠀀"), (12, "three", "知识𠀀")]
    while len(out) < n:
        kind, base = rnd.choice(["one", "two", "three"]), "abcd" if len(out) % 3 else "知识管理学z𠀀"
        body = "".join(rnd.choice(base) for _ in range(rnd.choice([2, 9, 30, 90])))
        if (kind, body) not in {r[1:] for r in out}:
            out.append((len(out) * 11 + 50, kind, body))
    return out


def _alike_pairs(rows, k, threshold):
    sh = lambda t: {t[i : i + k] for i in range(len(t) - k + 1)} if len(t) >= k else {t}
    jac = lambda a, b: len(a & b) / len(a | b)
    each = [(p, sh(t), sh(x)) for p, t, x in rows]
    sims = {(a, b): 0.3 * jac(t, u) + 0.7 * jac(x, y) for a, t, x in each for b, u, y in each if a < b}
    return {p: s for p, s in sims.items() if s >= threshold}


@pytest.mark.parametrize("k,meetings,tiles", [(1, 7, (5, 9)), (2, 1 << 20, (16, 4)), (3, 40, (200, 200)), (5, 40, (64, 32))])
def test_tiles_count_what_sets_share(monkeypatch, k, meetings, tiles):
    for name, value in zip(("MEETINGS", "TILE_X", "TILE_Y"), (meetings, *tiles)):
        monkeypatch.setattr(grid, name, value)
    texts = [x for _, _, x in _alike_texts(150)]
    sh = lambda t: {t[i : i + k] for i in range(len(t) - k + 1)} if len(t) >= k else {t}
    for table, rare in ((4, 4), (1 << 20, 1), (1 << 20, 10**6)):
        monkeypatch.setattr(grid, "TABLE", table)
        of, code, kinds = grid.shingled(texts, k)
        often, mid = np.bincount(code, minlength=kinds) * rare > len(texts), 60
        one, cut = grid.Sets(of, code, often, len(texts)), int(np.searchsorted(of, mid))
        x, y = grid.Sets(of[:cut], code[:cut], often, mid), grid.Sets(of[cut:] - mid, code[cut:], often, len(texts) - mid)
        for least in (0.0, 0.5):
            for got, wanted in ((grid.alike(one, one, least), lambda i, j: i < j), (grid.alike(x, y, least), lambda i, j: i < mid <= j)):
                off = 0 if wanted(0, 1) else mid
                found = {}
                for a, b, shared, either in got:
                    for i, j, s, e in zip(a.tolist(), (b + off).tolist(), shared.tolist(), either.tolist()):
                        assert (min(i, j), max(i, j)) not in found
                        found[min(i, j), max(i, j)] = s, e
                for i in range(len(texts)):
                    for j in range(len(texts)):
                        if wanted(i, j):
                            p, q = sh(texts[i]), sh(texts[j])
                            assert found.get((i, j), (len(p & q), len(p | q))) == (len(p & q), len(p | q))
                            assert (i, j) in found or len(p & q) < least * len(p | q)


@pytest.mark.parametrize("way", ["blocks", "index", "index too costly"])
def test_blocks_and_index_find_all_similar_pairs(spark, monkeypatch, way):
    """Texts over few letters share most shingles; only similar pairs leave a task, and both ways find the same."""
    rows = _alike_texts(150)
    df = spark.createDataFrame(rows, "pos long, title string, content string")
    monkeypatch.setattr(grid, "LEAST_CHARS", 1000)
    if way != "blocks":
        monkeypatch.setattr(dedup, "SURE_BLOCKS", 0)
        monkeypatch.setattr(dedup, "_meetings", lambda *_: 0 if way == "index" else 10**18)
    assert grid.blocks(sum(len(r[2]) for r in rows)) > 3
    for k, threshold in ((2, 0.45), (3, 0.65)):
        want = _alike_pairs(rows, k, threshold)
        got = dedup.similarity_edges(df, k, threshold).collect()
        assert len(got) == len(want) > 20 and {(r.a, r.b): r.sim for r in got} == want
    assert ("MapInArrow" in dedup.similarity_edges(df, 3, 0.65)._jdf.queryExecution().toString()) == (way != "index")


def test_spanning_edges_connect_what_all_edges_connect(spark, monkeypatch):
    rows = _alike_texts(150)
    df = spark.createDataFrame(rows, "pos long, title string, content string")
    monkeypatch.setattr(grid, "LEAST_CHARS", 1000)
    full, few = (dedup.similarity_edges(df, 2, 0.6, spanning=x) for x in (False, True))
    n = grid.blocks(sum(len(r[2]) for r in rows))
    # a text is in one task of each block, and a task has fewer edges than texts
    assert few.count() < n * len(rows) and few.count() < full.count()
    assert sorted(dedup.members(df, few).collect()) == sorted(dedup.members(df, full).collect())


def test_merge_of_texts_over_few_letters_needs_few_edges(spark, monkeypatch):
    rows = _alike_texts(150)
    df = spark.createDataFrame([(p, t, x, "r_p1", "Term") for p, t, x in rows], "pos long, title string, content string, reference string, card_type string")
    monkeypatch.setattr(grid, "LEAST_CHARS", 1000)
    k, threshold = dedup.settings(df)
    edges, real = [], dedup._labels
    monkeypatch.setattr(dedup, "_labels", lambda c, e, *pos: real(c, edges.append(e.count()) or e, *pos))
    got = dedup.dedup_cards(df).collect()
    assert edges[0] < grid.blocks(sum(len(r[2]) for r in rows)) * len(rows) < len(_alike_pairs(rows, k, threshold))
    full = dedup.similarity_edges(df, k, threshold)
    root = {p: p for p, _, _ in rows}

    def find(x):
        return x if root[x] == x else find(root[x])

    for e in full.collect():
        root[find(e.a)] = find(e.b)
    groups = {}
    for p in root:
        groups[find(p)] = groups.get(find(p), 0) + 1
    assert sorted(r.merged for r in got) == sorted(groups.values())


def test_merge(spark):
    long = "认知负荷理论说明了学习过程中的限制。" * 14
    c = _cards(spark, [("标题", long + "独特的一句话在这里出现。", "来源A_p1", "Term"), ("标题", long, "来源B_p2", "Term"), ("别的", "完全不同的内容。" * 30, "来源C_p3", "Term")])
    got = dedup.dedup_cards(c).collect()
    assert len(got) == 2
    merged = next(r for r in got if r.merged == 2)
    assert "整合" in merged.title and {"来源A_p1", "来源B_p2"} == set(merged.reference.split("; "))
    assert dedup.adaptive(50) == (2, 0.40) and dedup.adaptive(150) == (2, 0.45) and dedup.adaptive(300) == (3, 0.65)
    assert dedup.dedup_cards(c.limit(0)).count() == 0


# entities
def _entities(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos long, name string, entity_type string, context string")


@pytest.mark.parametrize("rows,want", [
    ([("人物A（职称）", "人", "x"), ("人物A", "人", "y")], {("人物A（职称）", "x；y")}),
    ([("人物B·人物C", "人", ""), ("人物C", "人", "")], {("人物B·人物C", "")}),
    ([("同名", "人", "a"), ("同名", "地", "b")], {("同名", "a"), ("同名", "b")}),
    ([("概念C", "念", "a"), ("概念D", "念", "b")], {("概念C", "a"), ("概念D", "b")}),
])
def test_unify(spark, rows, want):
    assert {(r.name, r.context) for r in entities.unify(_entities(spark, rows)).collect()} == want


def test_entity_names(spark):
    assert entities.normal_name("人物A [职称A]") == "人物a" and entities.strip_brackets("a(b(c)d)e)f(g") == "aef"
    assert [entities.levenshtein(*p) for p in (("abc", "abd"), ("abc", ""), ("ab", "ba"))] == [1, 3, 2]
    e = _entities(spark, [("实体A", "x", ""), ("实体a", "x", ""), ("实体B", "x", "")])
    assert entities.exact_dedup(e).count() == 2
    raw = spark.createDataFrame([('{"entities":[{"name":"a","type":"t"},{"name":" "}]}',), ('[{"name":"b"}]',), ("bad",), (None,)], "raw string")
    assert {(r.name, r.entity_type) for r in entities.parse_entities(raw, "raw").collect()} == {("a", "t"), ("b", "未知")}


# typography, chunks, pages, rendering
@pytest.mark.parametrize("given,want", [
    ("字English字", "字 English 字"), ("字, 字.", "字， 字。"), ("字。。。字。。", "字。字。"), ("字(字)字", "字（字）字"), ("```\n字a字\n```", "```\n字a字\n```"),
    ("|字a|字,|", "|字 a|字,|"), ("pure English, text.", "pure English, text."), ("纯中文。", "纯中文。"), ("", ""), ("字\"Hello\"字", "字“Hello”字"), ("a    b", "a  b"),
])
def test_typo(given, want):
    assert typo.typo_fix(given)[0] == want


def test_chunks():
    body = "".join(f"# H{i}\n## S\n" + "line of text\n" * 400 for i in range(6))
    got = chunk.chunks(body, 10_000)
    assert len(got) > 2 and all(len(t.encode()) > 200 for _, t in got) and got[0][0] == "H0 > S"
    assert "".join(got[0][1]).startswith("# H0 > S\n\n# H0\n")
    assert chunk.chunks("short", 10_000) == [("", "short")] and chunk.chunks(" ", 10_000) == []
    assert chunk.overlap("x" * 10, ["标题B", "标题C"]) == "# 标题B\n## 标题C\n\n" + "x" * 10


def test_headers_and_footers(spark):
    page = "## 第 {0} 页\n标题B\n作者A\n正文内容{0}在这里\n— {0} —\n"
    rows = [(1, "".join(page.format(i) for i in range(1, 11))), (2, "no marks"), (3, None), (4, page.format(1))]
    got = {r.doc_id: r for r in pages.strip_headers_footers(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "标题B" not in got[1].text and all(f"正文内容{i}" in got[1].text for i in range(1, 11)) and "— 3 —" not in got[1].text
    assert got[2].text == "no marks" and got[3].text == "" and got[4].text == page.format(1)


def test_pages_by_row(spark):
    """Repeated and null keys: each row by itself."""
    doc = "".join(f"## 第 {k} 页\n抬头 报告\n正文 {k} 一\n正文 {k} 二\n— {k} —\n" for k in range(1, 6))
    rows = [(1, doc), (1, doc), (None, doc), (2, None), (3, "## 第 1 页\nx"), (4, "no pages\r\nat all")]
    got = pages.strip_headers_footers(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 6
    assert sorted((str(r.doc_id), r.pages, r.removed) for r in got) == [("1", 5, 10), ("1", 5, 10), ("2", 1, 0), ("3", 1, 0), ("4", 1, 0), ("None", 5, 10)]
    assert {r.text for r in got if r.pages == 5} == {"\n\n".join(f"## 第 {k} 页\n\n正文 {k} 一\n正文 {k} 二" for k in range(1, 6))}


def test_rendering(spark):
    c = spark.createDataFrame([("标题", "a\n# b---", "Term", "r_p1"), ("q", "x", "Quote", "")], "title string, content string, card_type string, reference string")
    md = [r[0] for r in c.select(render.card_markdown(c)).collect()]
    assert md[0] == "# 术语卡\n\n**标题：** 标题\n\na\n\\# b\\---\n\n**ref：** r_p1\n\n***\n" and md[1].startswith("# 金句卡\n\n**标题：** q\n\nx")
    for a, b in (("a/b:c", "a_b_c"), ("  标题  ", "标题"), ("test|file?", "test_file_")):
        assert col(spark, a, render.file_name) == b
    assert col(spark, "x\n## 节\n", lambda t: render.guess_title(t, F.lit("stem"))) == "节" and col(spark, "x", lambda t: render.guess_title(t, F.lit(""))) == "未命名"


# sources, model stage, history, streaming
@pytest.mark.parametrize("data,want", [(bytes([0x83, 0x65, 0x83, 0x58, 0x83, 0x67]), "テスト"), (bytes([0xC5, 0xD7, 0xBD, 0xBA, 0xC6, 0xAE]), "테스트"), ("字a".encode("utf-16"), "字a"), ("é知".encode(), "é知"), (b"", "")])
def test_decode(data, want):
    assert readers.decode(data) == want


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("标题".encode("gbk"))
    (tmp_path / "b.pdf").write_bytes(b"1 0 obj /Type /Page /Type /Font /Type /Font /Type /Font")
    got = readers.read_text(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0].text
    assert [(r.status, r.confidence) for r in readers.scan(spark, str(tmp_path)).collect()] == [("HasText", 95)]
    assert readers.html_markdown("<head><title>t</title></head><h1>A &amp; B</h1><p>x<br>y</p><ul><li>i</li></ul>") == "# A & B\nx\ny\n- i"


def test_model_stage(spark):
    chunks = spark.createDataFrame([(1, 0, "t", "正文"), (1, 1, "t", "二")], "doc_id long, chunk_idx int, title_path string, text string")
    done = spark.createDataFrame([(1, 1)], "doc_id long, chunk_idx int")
    raw = llm_stage.compile_chunks(llm_stage.pending(chunks, done), "see {document}", llm_stage.Echo)
    assert [(r.title, r.card_type) for r in llm_stage.parse_cards(raw, "Term").collect()] == [("see 正文", "Term")]
    assert col(spark, "x\n```json\n{\"a\": 1}\n```", llm_stage.degrade) == '{"a": 1}' and col(spark, "  ", llm_stage.degrade) is None
    assert col(spark, '{"choices":[{"message":{"content":"","reasoning_content":"r"}}],"usage":{"input_tokens":3}}', llm_stage.answer_text) == "r"
    assert col(spark, '{"usage":{"input_tokens":3,"output_tokens":4}}', llm_stage.usage).total_tokens == 7


def test_whole_plan(spark):
    docs = spark.createDataFrame([(1, "这是一个完整的句子，内容足够长。" * 40), (2, None)], "doc_id long, text string")
    got = plan.compile_documents(docs, {"Knowledge": "{document}"}, llm_stage.Echo, 10_000)
    assert got.count() == 0  # the stand-in's cards have no reference, so none is valid


def test_history_ids(spark):
    c = spark.range(1000).select(F.col("id").alias("pos")).repartition(7)
    ids = [r.unique_id for r in history.unique_ids(c, "20240101235959").orderBy("pos").collect()]
    assert ids[0] == "20240101235959" and ids[1] == "20240102000000" and len(set(ids)) == 1000 and ids == sorted(ids)


def test_sinks(spark, tmp_path):
    c = _cards(spark, [("t", "c", "r", "Term")])
    sinks.save_cards(c, str(tmp_path / "p"))
    sinks.save_markdown(c, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1 and list((tmp_path / "m" / "card_type=Term").glob("*.txt"))
    good, bad = sinks.gate(lint.lint(c.withColumn("original_text", F.lit("")).withColumn("source", F.lit(""))))
    assert good.count() + bad.count() == 1


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("some text")
    ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "in" / "b.txt").write_text("more text")
    ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_components_in_one_task_and_in_many(spark, monkeypatch):
    from corpusloom.plans import shared

    path = [(i, i + 1) for i in range(0, 60)]
    edges = path[::2] + path[1::2] + [(100, 70), (70, 90), (5, 5)]
    want = {n: 0 for n in range(61)} | {70: 70, 90: 70, 100: 70}
    for most in (1 << 16, 40):
        monkeypatch.setattr(shared, "TASK_EDGES", most)
        rows = shared.connected_components(spark.createDataFrame([*edges, (None, 3), (3, None)], "a long, b long")).collect()
        assert len(rows) == len(want) and dict(map(tuple, rows)) == want
    assert shared.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
