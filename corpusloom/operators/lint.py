"""Card lint: issues, score, status and gate as one projection; reference format test and repair.

A card is a row with title, content, card_type, reference, original_text, source (strings; null is empty).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_class, let, pin, text, utrim
from .similarity import lcs_ratio

MIN_LENGTH, MAX_GARBAGE, MIN_DENSITY, DENSITY_FROM, COPIED, REVIEW_LENGTH = 30, 0.3, 0.05, 50, 0.8, 120
# fixed values: weighted markers of information density; a term that stands twice counts twice
ACADEMIC = "研究发现 研究表明 实验证明 实验表明 理论 模型 框架 机制 原理 规律 概念 定义 术语 范式 假设 推论 认知 心理 神经 行为 情绪 动机 结构 系统 模式 流程 算法 函数".split()
CITATION = "提出 指出 认为 主张 强调 总结 引用 借鉴 参考 依据 根据 基于".split()
QUANTIFIERS = "数据 证据 统计 调查 百分比 比例 数量 数值 指标 维度 程度 水平 大约 约 超过 低于 达到 增至".split()
CONNECTORS = (
    "比如 例如 如 像 譬如 首先 其次 再次 最后 第一 第二 第三 因此 所以 因而 从而 于是 然而 但是 不过 却 而 反而 虽然 尽管 即使 纵然 如果 假设 若 只要 只有 那么 则 不仅 不但 而且 并且 同时 此外 另外 因为 由于 鉴于 考虑到 不同于 相较于 相比 相对 相反 反之 "
    "分为 包括 涵盖 包含 涉及 关于 通过 凭借 利用 采用 运用 使用 导致 造成 引起 引发 产生 带来 影响 作用 效果 结果 后果 成果 区别 差异 区分 辨别 识别 比较 对比 对照 类比 关键 核心 本质 实质 根本 重点 要点 原因 理由 根源 由来 起因 目的 目标 意图 旨在 为了 "
    "意义 价值 重要性 作用 方法 方式 途径 手段 策略 技巧 步骤 分析 解析 剖析 解读 阐释 阐明 论述 论证 总结 归纳 概括 综述 回顾 梳理 具体 详细 明确 清晰 确切 明确 实例 案例 事例 例子 样板 典型"
).split()
STRUCTURE = "： : 1. 2. 3. 4. 5. 一、 二、 三、 四、 五、 （1） （2） （3） ① ② ③".split()
QUOTES = ["「", "【", "《", '"', "'", "(", "（"]
MARKERS = [*((m, 2.0) for m in ACADEMIC), *((m, 1.5) for m in [*CITATION, *QUOTES, *QUANTIFIERS]), *((m, 1.0) for m in CONNECTORS), *((m, 0.5) for m in STRUCTURE)]
TYPE_LABELS = {"Knowledge": "新知卡", "Person": "人物卡", "Term": "术语卡", "Quote": "金句卡", "Action": "行动卡", "CounterIntuit": "反常识卡", "Review": "综述卡"}
STEP_WORDS, TRIGGER_WORDS = "步骤 首先 其次 最后 1. 2.".split(), "当 如果 适用 场景 触发".split()
DEFINITION_WORDS, EXAMPLE_WORDS = "是指 定义 概念 指的是 意味着".split(), "例如 比如 例子 表现为".split()
BAD_SOURCE = ["《", "》", "本书", ";", "[", "]"]
BAD_START = ["[法]", "[美]", "[英]", "[德]", "[日]", "[中]", "[意]", "[奥]", "[俄]", "（"]
TITLE_PUNCTUATION = " 　、。，：；！？“”‘’（）《》〈〉·\"'()[]{}<>"
CRITICAL = ["EmptyTitle", "InvalidRefFormat", "TypeConfusion", "QuoteMissingSource", "MissingEvidence", "EvidenceNotFound"]
MAJOR = ["EmptyOrShortContent", "HighGarbageRatio", "LikelyCopied", "TitleContentMismatch"]
INVALID = ["EmptyTitle", "EmptyOrShortContent", "QuoteMissingSource", "InvalidRefFormat", "TypeConfusion"]
RETRY = ["ActionMissingSteps", "TermMissingDefinition", "ReviewMissingSynthesis"]


def any_of(c: Column, words: list[str]) -> Column:
    out = c.contains(words[0])
    for w in words[1:]:
        out = out | c.contains(w)
    return out


def garbage_ratio(c: Column) -> Column:
    return count_class(c, r"�-\x{F0000}-\x{10FFFD}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F") / F.greatest(F.length(c), F.lit(1))


def info_density(c: Column) -> Column:
    """Weighted markers per hundred characters; not bounded."""
    score = count_class(c, "0-9") * 0.5
    for weight in (2.0, 1.5, 1.0, 0.5):
        marks = F.array(*[F.lit(m) for m, w in MARKERS if w == weight])
        hits = let(c, lambda t, marks=marks: F.aggregate(F.transform(marks, lambda m: (F.length(t) - F.length(F.replace(t, m, F.lit("")))) / F.length(m)), F.lit(0.0), lambda a, x: a + x))
        score = score + hits * weight
    return F.when(c == "", 0.0).otherwise(score * 100 / F.greatest(F.length(c), F.lit(1)))


def title_matches(title: Column, content: Column) -> Column:
    """The title, or any two neighbouring characters of it without punctuation, stand in the content."""
    bare = F.translate(title, TITLE_PUNCTUATION, "")
    pairs = let(bare, lambda b: F.when(F.length(b) >= 2, F.transform(F.sequence(F.lit(1), F.greatest(F.length(b) - 1, F.lit(1))), lambda i: F.substring(b, i, F.lit(2)))).otherwise(F.array().cast("array<string>")))
    return content.contains(utrim(title)) | F.exists(pairs, lambda g: content.contains(g))


def ref_ok(reference: Column) -> Column:
    """``<source>_p<digit>`` with an admissible source name."""

    def test(r: Column) -> Column:
        at = F.locate("_p", r)
        source, after = F.when(at > 0, F.substring(r, F.lit(1), at - 1)).otherwise(""), F.substring(r, at + 2, F.lit(1))
        latin = source.rlike(r"\A(?U:[A-Za-z\s.\-&;]){2,}\z")
        start = F.lit(False)
        for p in BAD_START:
            start = start | source.startswith(p)
        return (at > 0) & after.rlike("^[0-9]") & (source != "") & ~any_of(source, BAD_SOURCE) & ~latin & ~start

    return let(utrim(reference), test)


def score(issues: Column) -> Column:
    def n(codes: list[str]) -> Column:
        return F.size(F.filter(issues, lambda i: i["code"].isin(codes)))

    minor = F.size(issues) - n(CRITICAL) - n(MAJOR)
    return F.greatest(1 - F.least(n(CRITICAL) * 0.4, F.lit(0.9)) - F.least(n(MAJOR) * 0.15, F.lit(0.5)) - F.least(minor * 0.05, F.lit(0.3)), F.lit(0.1))


def lint(cards: DataFrame, min_length: int = MIN_LENGTH, max_garbage: float = MAX_GARBAGE, min_density: float = MIN_DENSITY) -> DataFrame:
    """``cards`` with issues array<struct<code, message>>, quality_score, is_valid, status, reject_reason, is_gated.

    Issues stand in the order of the rules. A card with any of ``INVALID`` is invalid: NeedsRetry if a structural issue
    asks for one more try, else Rejected. ``is_gated`` is the stricter test at writing: accepted and without any reason.
    """
    c = {n: text(n) for n in ("title", "content", "card_type", "reference", "original_text", "source")}
    kind, content, n = c["card_type"], c["content"], F.length(c["content"])
    d = cards.select("*", garbage_ratio(content).alias("_g"), info_density(content).alias("_d"), lcs_ratio(F.when((kind != "Quote") & (c["original_text"] != ""), content), c["original_text"]).alias("_s"))

    def issue(test: Column, code: str, *message) -> Column:
        return F.when(test, F.struct(F.lit(code).alias("code"), F.concat(*[F.lit(m) if isinstance(m, str) else m for m in message]).alias("message")))

    fmt = lambda pattern, x: F.format_string(pattern, x)
    rules = [
        issue(utrim(c["title"]) == "", "EmptyTitle", "标题为空"),
        issue(n < min_length, "EmptyOrShortContent", "内容过短: ", n.cast("string"), f"字 < 要求{min_length}字"),
        issue(F.col("_g") > max_garbage, "HighGarbageRatio", "乱码比例过高: ", fmt("%.1f", F.col("_g") * 100), f"% > {max_garbage * 100:.1f}%"),
        issue((F.col("_d") < min_density) & (n >= DENSITY_FROM), "LowInfoDensity", "信息密度过低: ", fmt("%.2f", F.col("_d")), f" < {min_density:.2f}"),
        issue((c["title"] != "") & (content != "") & ~title_matches(c["title"], content), "TitleContentMismatch", "标题与内容不匹配"),
        issue((kind == "Quote") & (c["original_text"] != "") & (c["source"] == ""), "ReferenceMismatch", "引用与原文不匹配"),
        issue((content != "") & (F.col("_s") > COPIED), "LikelyCopied", "疑似直接复制原文: 相似度", fmt("%.1f", F.col("_s") * 100), "%"),
        issue(c["reference"].rlike(r"[�\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"), "ReferenceMismatch", "引用与原文不匹配"),
        issue(~ref_ok(c["reference"]), "InvalidRefFormat", "ref格式不符合规范"),
        issue((kind == "Term") & any_of(c["title"], list(TYPE_LABELS.values())), "TypeConfusion", "卡片类型混淆：内容不属于该类型"),
        issue((kind == "Quote") & ((utrim(c["original_text"]) == "") | (utrim(c["source"]) == "")), "QuoteMissingSource", "金句卡缺少原文或出处"),
        issue((kind == "Action") & ~any_of(content, STEP_WORDS + TRIGGER_WORDS), "ActionMissingSteps", "行动卡缺少步骤或触发条件"),
        issue((kind == "Term") & ~any_of(content, DEFINITION_WORDS + EXAMPLE_WORDS), "TermMissingDefinition", "术语卡缺少定义或例子"),
        issue((kind == "Review") & (n < REVIEW_LENGTH), "ReviewMissingSynthesis", "综述卡缺少跨主题连接"),
    ]
    d = pin(d.withColumn("issues", F.array_compact(F.array(*rules))).drop("_g", "_d", "_s"))
    codes = F.transform("issues", lambda i: i["code"])
    has = lambda which: F.arrays_overlap(codes, F.array(*[F.lit(x) for x in which]))
    d = d.withColumn("quality_score", F.when(F.size("issues") == 0, 1.0).otherwise(score(F.col("issues")))).withColumn("is_valid", ~has(INVALID))
    d = d.withColumn("status", F.when(F.col("is_valid"), "Accepted").when(has(RETRY), "NeedsRetry").otherwise("Rejected"))
    d = d.withColumn("reject_reason", F.array_join(F.transform("issues", lambda i: i["message"]), "；"))
    return d.withColumn("is_gated", (F.col("reject_reason") != "") | (F.col("status") != "Accepted"))


def lint_stats(linted: DataFrame) -> DataFrame:
    """(message code, number of cards with it), counted over exploded issues."""
    return linted.select(F.explode("issues").alias("i")).groupBy(F.col("i.code").alias("code")).agg(F.count("*").alias("n"))


def quality_report(linted: DataFrame) -> DataFrame:
    """Count and mean score by status, by type and in all."""
    return linted.groupingSets([["status"], ["card_type"], []], "status", "card_type").agg(F.count("*").alias("n"), F.round(F.avg("quality_score"), 6).alias("mean_score"))


def repair_ref(reference: Column, source_text: Column, books: list[str]) -> Column:
    """The rewrites that need no page search, in their order; full-width digits become ASCII last."""
    book = F.coalesce(F.get(F.filter(F.array(*[F.lit(b) for b in books]), lambda b: source_text.contains(b)), F.lit(0)), F.lit("来源")) if books else F.lit("来源")

    def first(r: Column) -> Column:
        inside = lambda x: F.when(x.rlike("《[^》]+》"), F.regexp_extract(x, "《([^》]+)》", 1)).otherwise(x)
        cite = r"^(.+)[,，]\s*p[.．]?(\d+).*\z"
        return (
            F.when(r.rlike(r"^.+_第\d+(?:-\d+)?页\z"), F.regexp_replace(r, r"^(.+)_第(\d+)(?:-\d+)?页\z", "$1_p$2"))
            .when(r.rlike(r"^本书第\d+页\z"), F.concat(book, F.lit("_p"), F.regexp_extract(r, r"(\d+)", 1)))
            .when(r.rlike(cite), F.concat(inside(F.regexp_extract(r, cite, 1)), F.lit("_p"), F.regexp_extract(r, cite, 2)))
            .otherwise(r)
        )

    def second(r: Column) -> Column:
        author = r"^(?:\[[^\]]+\]\s*)?[^\s《]+《([^》]+)》"
        tail = F.substring_index(r, "_p", -1)
        r = F.when(r.rlike(author) & r.contains("_p"), F.concat(F.regexp_extract(r, author, 1), F.lit("_p"), tail)).otherwise(r)
        return F.translate(r, "０１２３４５６７８９", "0123456789")

    return let(utrim(reference), lambda r: let(first(r), lambda x: let(F.regexp_replace(x, r"_p\.(\d+)\z", "_p$1"), second)))


def page_of(source_text: Column, keyword: Column, window: int = 500) -> Column:
    """The first page marker whose next ``window`` bytes hold the keyword, else null."""
    parts = F.split(source_text, r"(?=## 第 \d+ 页)", -1)
    # a character that the window cuts in two is replaced, so it cannot match
    cut = lambda t: F.make_valid_utf8(F.substring(F.encode(t, "UTF-8"), 1, window).cast("string"))

    def find(p: Column) -> Column:
        after = lambda i: F.regexp_replace(F.array_join(F.slice(p, i + 1, F.size(p)), ""), r"^## 第 \d+ 页", "")
        at = F.transform(p, lambda x, i: F.when(x.rlike(r"^## 第 \d+ 页") & cut(after(i)).contains(keyword), F.regexp_extract(x, r"^## 第 (\d+) 页", 1)))
        return F.get(F.array_compact(at), F.lit(0))

    return F.when(keyword != "", let(parts, find))


#: What a citation without a page can look like; the group is what the page search looks for.
BOOK_IN_MARKS, AUTHOR_YEAR, TITLE_IN_PARENTHESES = r"《([^》]+)》", r"^([^_]+)_\d{4}_", r"^([^（(]+)[（(][^，,)）]+[，,]\s*\d{4}[)）]"


def title_keywords(title: Column) -> Column:
    """The first two parts of a title, between punctuation, of two characters or more."""
    parts = F.transform(F.split(title, r"[\p{Punct}，？！]", -1), utrim)
    return F.slice(F.filter(parts, lambda p: F.length(p) >= 2), 1, 2)


def repair_ref_by_page(reference: Column, title: Column, source_text: Column, books: list[str]) -> Column:
    """All rewrites: those without a page search first, then the pages at which the source names the book, the author or the title's concepts.

    A reference that stays without ``_p`` and a digit takes the page of the first title keyword that stands within 1000 bytes of a
    page marker. An empty reference stays; where nothing is found the reference stays as the first rewrites left it.
    """
    known = F.coalesce(F.get(F.filter(F.array(*[F.lit(b) for b in books]).cast("array<string>"), lambda b: source_text.contains(b)), F.lit(0)), F.lit("来源"))
    page = lambda word, window=500: page_of(source_text, utrim(word), window)

    def to(r: Column, name: Column, pattern: str, group_name: bool) -> Column:
        word = F.regexp_extract(r, pattern, 1)
        found = F.when(r.rlike(pattern) & ~r.contains("_p"), page(word))
        return let(found, lambda p: F.when(p.isNotNull(), F.concat(utrim(word) if group_name else name, F.lit("_p"), p)).otherwise(r))

    def concept(r: Column) -> Column:
        asked = (F.locate("_p", r) == 0) | ~F.substring(r, F.locate("_p", r) + 2, F.lit(1)).rlike("^[0-9]")
        hits = F.array_compact(F.transform(title_keywords(title), lambda w: page_of(source_text, w, 1000)))
        return let(F.when(asked & (source_text != ""), F.get(hits, F.lit(0))), lambda p: F.when(p.isNotNull(), F.concat(known, F.lit("_p"), p)).otherwise(r))

    def searched(r: Column) -> Column:
        return let(to(r, known, BOOK_IN_MARKS, True), lambda a: let(to(a, known, AUTHOR_YEAR, False), lambda b: let(to(b, known, TITLE_IN_PARENTHESES, False), concept)))

    return F.when(utrim(reference) == "", reference).otherwise(let(repair_ref(reference, source_text, books), searched))


def evidence_issue(evidence: Column, source_text: Column, status: Column) -> Column:
    """MissingEvidence, EvidenceNotFound or null; rejected cards are not asked."""
    e = utrim(text(evidence))
    return F.when(status == "Rejected", None).when(e == "", "MissingEvidence").when((source_text != "") & ~source_text.contains(e), "EvidenceNotFound")


def filter_cards(cards: DataFrame, books: list[str], source_text: str | None = None, **limits) -> tuple[DataFrame, DataFrame]:
    """(valid cards, stats by issue): references are repaired first (by pages where the column ``source_text`` is given), then linted."""
    source = text(source_text) if source_text else F.lit("")
    fixed = repair_ref_by_page(text("reference"), text("title"), source, books) if source_text else repair_ref(text("reference"), source, books)
    linted = lint(cards.withColumn("reference", fixed), **limits)
    return linted.where("is_valid"), lint_stats(linted)
