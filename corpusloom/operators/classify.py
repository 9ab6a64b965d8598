"""Document-type classification by feature scores, best score and margin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_sub, lines, pin, text

#: code, label, chunk size, cards a chunk, chapters, entities, cross references
CONFIGS = (
    ("Book", "书籍", 50000, 30, True, True, True),
    ("Paper", "论文", 30000, 25, False, True, True),
    ("Article", "文章", 15000, 15, False, False, False),
    ("Report", "报告", 40000, 25, True, True, False),
    ("Manual", "手册", 35000, 20, True, False, False),
)
WORDS = {
    "has_abstract": ("摘要", "abstract"),
    "has_keywords": ("关键词", "keywords"),
    "has_references": ("参考文献", "references", "bibliography"),
    "has_toc": ("目录", "contents"),
    "has_appendix": ("附录", "appendix"),
    "has_preface": ("前言", "preface"),
    "has_conclusion": ("结论", "conclusion"),
    "has_figure": ("图", "figure", "fig."),
}


def features(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with a struct ``f`` of counts and flags. A null text is empty."""
    t = text(column)
    d = docs.withColumn("_t", t).withColumn("_l", lines(F.col("_t"))).withColumn("_low", F.lower("_t"))
    low = F.col("_low")
    has = {name: F.greatest(*[low.contains(w) for w in (*words, words[0])]) for name, words in WORDS.items()}
    f = F.struct(
        F.length("_t").cast("long").alias("char_count"),
        F.size("_l").cast("long").alias("line_count"),
        *[F.expr(f"cast(size(filter(_l, x -> startswith(x, '{'#' * k} '))) as long)").alias(f"h{k}_count") for k in (1, 2, 3)],
        *[c.alias(n) for n, c in has.items()],
        F.col("_t").contains("```").alias("has_code"),
        (F.col("_t").contains("| ") & (F.size(F.filter("_l", lambda x: x.contains("|"))) > 3)).alias("has_table"),
        (count_sub(low, "步骤") + count_sub(low, "step") + count_sub(low, "1. ") + count_sub(low, "2. ")).alias("step_count"),
    )
    return pin(d.withColumn("f", f).drop("_t", "_l", "_low"))


def _points(*rules: tuple[Column, int]) -> Column:
    return sum((F.when(c, p).otherwise(0) for c, p in rules[1:]), F.when(rules[0][0], rules[0][1]).otherwise(0))


def scores() -> dict[str, Column]:
    """Points of each type; the rules are fixed values."""
    c = lambda n: F.col(f"f.{n}")
    article = _points((c("char_count") < 3000, 20), (c("h1_count") >= 1, 10), (c("h1_count") <= 2, 10), (c("h2_count") <= 3, 5), (~c("has_references"), 5), (~c("has_toc"), 3), (~c("has_appendix"), 3), (~c("has_abstract"), 5))
    return {
        "Book": _points((c("char_count") > 5000, 20), (c("char_count") > 20000, 10), (c("h1_count") >= 3, 25), (c("h2_count") >= 3, 15), (c("has_toc"), 40), (c("has_preface"), 20), (c("has_appendix"), 15), (c("has_references"), 5)),
        "Paper": _points((c("has_abstract"), 45), (c("has_keywords"), 30), (c("has_references"), 30), (c("has_figure"), 10), (c("char_count") > 2000, 5), (c("has_conclusion"), 5)),
        "Article": F.when(c("char_count") == 0, 0).otherwise(article),
        "Report": _points((c("has_table"), 35), (c("has_abstract"), 20), (c("has_conclusion"), 20), (c("char_count") > 1000, 10), (c("h1_count") >= 2, 10), (c("has_references"), 5)),
        "Manual": _points((c("has_code"), 40), (c("step_count") >= 2, 25), (c("h2_count") >= 2, 15), (c("has_table"), 5), (~c("has_abstract"), 5), (~c("has_references"), 5)),
    }


def classify(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with doc_type, confidence, best_score and second_score."""
    d = features(docs, column)
    ranked = F.reverse(F.array_sort(F.array(*[F.struct(s.alias("s"), F.lit(i).alias("i"), F.lit(t).alias("t")) for i, (t, s) in enumerate(scores().items())])))
    d = d.withColumn("_r", ranked).withColumn("best_score", F.col("_r")[0]["s"]).withColumn("second_score", F.col("_r")[1]["s"])
    best, second = F.col("best_score"), F.col("second_score")
    unknown = (best < 20) | ((second > 0) & (best - second < 5))
    return d.withColumn("doc_type", F.when(unknown, "Unknown").otherwise(F.col("_r")[0]["t"])).withColumn("confidence", F.when(unknown, 30).otherwise(F.least((best - second) * 2 + best, F.lit(95)))).drop("_r", "f")


def configs(spark) -> DataFrame:
    """The five types' settings as a fixed small table."""
    return spark.createDataFrame(CONFIGS, "doc_type string, label string, chunk_size int, max_cards_per_chunk int, expect_chapters boolean, expect_entities boolean, expect_cross_refs boolean")


def valid_config(chunk_size: Column, max_cards: Column) -> Column:
    return chunk_size.between(1000, 500_000) & max_cards.between(1, 100)
