"""Exact near-duplicate detection of cards by shingle Jaccard, components, and merge.

sim = 0.3 J(title) + 0.7 J(content) >= threshold forces J(content) >= (threshold - 0.3) / 0.7. So candidates come from an
inverted index over each content's rarest shingles only (prefix filter), and exact copies are one candidate. Shingles are 64-bit
hashes in the index and in the verification. Where that index would meet more pairs than it is worth, and in tables of up to
SURE_BLOCKS blocks, blocks of texts are counted against each other instead (see ``grid``). Both ways are exact.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count_sub, jaccard, shingles, text
from ..plans.shared import connected_components, written
from . import grid

TITLE_WEIGHT, CONTENT_WEIGHT = 0.3, 0.7
#: The sets of all representatives are broadcast only if they were counted and have at most so many shingles (32 MB).
BROADCAST_SHINGLES = 4_000_000
#: Tables of at most so many blocks are compared block by block without a look at what an index would meet.
SURE_BLOCKS = 16


def adaptive(mean_length: int) -> tuple[int, float]:
    """Shingle size and threshold by the mean content length in characters."""
    return (2, 0.40) if mean_length < 100 else (2, 0.45) if mean_length < 200 else (3, 0.65)


def settings(cards: DataFrame) -> tuple[int, float]:
    return adaptive(cards.agg(F.floor(F.avg(F.length(text("content")))).alias("m")).first().m or 0)


def _keyed(cards: DataFrame) -> DataFrame:
    """``cards`` with a 128-bit key of (title, content); equal texts meet by it, so the texts need not be compared or shuffled."""
    title, content = text("title"), text("content")
    return cards.withColumn("_k", F.struct(F.xxhash64(title, content).alias("x"), F.xxhash64(content, F.lit(1), title).alias("y")))


def similarity_edges(cards: DataFrame, k: int, threshold: float, spanning: bool = False) -> DataFrame:
    """(a, b, sim) with a < b for representatives of equal (title, content); ``cards(pos, title, content)``.

    Copies of a representative are linked by membership (see ``members``), not by pairs. With ``spanning`` there are only as many
    pairs as connect what is similar, and sim may be null.
    ``pos`` must tell different texts apart (``dedup_cards`` numbers the rows itself).
    """
    reps = _keyed(cards).groupBy("_k").agg(F.min("pos").alias("pos"), F.first(text("title")).alias("title"), F.first(text("content")).alias("content"))
    reps = written(reps.where("pos is not null").drop("_k"), "reps")
    blocks = grid.blocks(reps.agg(F.sum(F.length("content")).alias("n")).first().n or 0)
    if blocks > SURE_BLOCKS:
        sets, prefix, first = _indexed(reps, k, threshold)
        if _meetings(prefix, first) <= blocks * sets.agg(F.sum(F.size("cs")).alias("n")).first().n:
            return _indexed_pairs(sets, prefix, first, threshold)
    return grid.similar(reps, blocks, k, threshold, (TITLE_WEIGHT, CONTENT_WEIGHT), spanning)


def _indexed(reps: DataFrame, k: int, threshold: float) -> tuple[DataFrame, DataFrame, Column]:
    """The hashed sets, their rarest shingles with their places, and which of those a smaller set is found by."""
    hashed = lambda c: F.transform(shingles(F.col(c), k), lambda x: F.xxhash64(x))
    sets = written(reps.select("pos", hashed("title").alias("ts"), hashed("content").alias("cs")), "sets")
    need = (threshold - TITLE_WEIGHT) / CONTENT_WEIGHT
    share = need / (1 + need)
    # different title sets cannot be as similar as equal ones: their sizes bound what the titles add
    tokens = sets.select("pos", F.size("cs").alias("n"), F.size("ts").alias("p"), F.xxhash64(F.array_sort("ts")).alias("h"), F.explode("cs").alias("s"))
    often = tokens.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    # a shingle of one document only cannot be shared; it still takes its place among the rarest
    rank = F.row_number().over(Window.partitionBy("pos").orderBy(F.coalesce("df", F.lit(1)), "s"))
    kept = F.col("df").isNotNull() & (F.col("r") <= F.col("n") - F.ceil(F.col("n") * need - 1e-9) + 1)
    prefix = written(tokens.join(often, "s", "left").select("pos", "n", "p", "h", "s", "df", rank.alias("r")).where(kept).select("pos", "n", "p", "h", "s", "r"), "prefix")
    return sets, prefix, F.col("r") <= F.col("n") - F.ceil(2 * share * F.col("n") - 1e-9) + 1


def _meetings(prefix: DataFrame, first: Column) -> int:
    """How many pairs of rows the index looks at."""
    return prefix.groupBy("s").agg(F.count("*").alias("y"), F.count(F.when(first, 1)).alias("x")).agg(F.sum(F.col("x") * F.col("y")).alias("n")).first().n or 0


def _indexed_pairs(sets: DataFrame, prefix: DataFrame, first: Column, threshold: float) -> DataFrame:
    """Pairs that meet at a common shingle in the order of rarity. What both sets have left from there bounds their overlap, so
    most meetings end in the join's condition; whole sets decide."""
    x, y = prefix.where(first).alias("x"), prefix.alias("y")
    order = "(x.n < y.n or x.n = y.n and x.pos < y.pos)"
    title = "case when x.h = y.h then 1 when x.p = y.p then (x.p - 1) / (x.p + 1) else least(x.p, y.p) / greatest(x.p, y.p) end"
    least = f"(({threshold} - {TITLE_WEIGHT} * {title}) / {CONTENT_WEIGHT})"
    # x.n <= y.n, and n shared shingles of the two need n * (1 + least) >= least * (x.n + y.n)
    fits = f"x.n >= y.n * {least} - 1e-9 and (least(x.n - x.r, y.n - y.r) + 1) * (1 + {least}) >= {least} * (x.n + y.n) - 1e-9"
    pairs = x.join(y, F.expr(f"x.s = y.s and {order} and {fits}")).select(F.least("x.pos", "y.pos").alias("a"), F.greatest("x.pos", "y.pos").alias("b")).distinct()
    small = (sets.agg(F.sum(F.size("ts") + F.size("cs")).alias("n")).first().n or 0) <= BROADCAST_SHINGLES
    one, two = (F.broadcast(t) if small else t for t in (sets.select(F.col("pos").alias("a"), F.col("ts").alias("ta"), F.col("cs").alias("ca")), sets.select(F.col("pos").alias("b"), F.col("ts").alias("tb"), F.col("cs").alias("cb"))))
    sim = TITLE_WEIGHT * jaccard(F.col("ta"), F.col("tb")) + CONTENT_WEIGHT * jaccard(F.col("ca"), F.col("cb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", sim.alias("sim")).where(F.col("sim") >= threshold)


def _labels(cards: DataFrame, edges: DataFrame, pos: str = "pos") -> DataFrame:
    """(_k, component) for each different (title, content) of keyed ``cards``; ``pos`` tells different texts apart."""
    reps = cards.groupBy("_k").agg(F.min(pos).alias("rep"))
    comp = connected_components(edges.select("a", "b"))
    return reps.join(comp, reps.rep == comp.node, "left").select("_k", F.coalesce("component", "rep").alias("component"))


def members(cards: DataFrame, edges: DataFrame) -> DataFrame:
    """(pos, component) for every card; a component is named by its smallest pos."""
    own = _keyed(cards).select("pos", "_k")
    return own.join(_labels(own, edges), "_k").select("pos", "component")


def density(c: Column) -> Column:
    marks = sum((count_sub(c, m) for m in ("【", "比如", "例如", "关键", "核心")), count_sub(c, "「"))
    return F.when(c == "", 0.0).otherwise(F.least(marks * 100 / F.greatest(F.length(c), F.lit(1)) / 5, F.lit(1.0)))


def quality(cards: DataFrame) -> Column:
    """Length band, density, structure and quote completeness; at most 1."""
    n, has = F.length(text("content")), lambda c: F.when(text(c) != "", 1.0).otherwise(0.0) if c in cards.columns else F.lit(0.0)
    band = F.when(n.between(200, 500), 1.0).when(n.between(100, 199), 0.7).when(n.between(501, 800), 0.8).when(n < 50, 0.1).otherwise(0.5)
    structure = 0.3 * has("title") + 0.3 * has("content") + 0.2 * has("reference") + 0.2 * has("unique_id")
    quote = F.when(text("card_type") == "Quote", 0.5 * has("original_text") + 0.3 * has("source") + 0.2 * has("paraphrase")).otherwise(0.0)
    return F.least(band * 0.3 + density(text("content")) * 0.25 + structure * 0.25 + quote * 0.2, F.lit(1.0))


def unique_sentences(content: str, canonical: str, k: int) -> list[str]:
    """Up to three sentences of ten bytes or more that hold a k-shingle which the canonical content lacks."""

    def sh(t: str, size: int) -> set[str]:
        return {t[i : i + size] for i in range(len(t) - size + 1)} if len(t) >= size else {t}

    new, out = sh(content, k) - sh(canonical, k), []
    for ch in "！？\n":
        content = content.replace(ch, "。")
    for s in content.split("。"):
        s = s.strip()
        if len(s.encode()) >= 10 and sh(s, 3) & new and not any(s in o for o in out):
            out.append(s)
    return out[:3]


def merge(cards: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """One card per component: the best one (the last of equals), with supplements and all references.

    ``cards(pos, title, content, reference, card_type, _k, _row, ...)`` are keyed and each row counts by itself, also where a pos is
    repeated; ``labels(_k, component)``. The best card is found by an aggregation; each other card meets only the best one.
    """
    d = cards.join(labels, "_k").select("component", "pos", "_row", *[text(c).alias(c) for c in ("title", "content", "reference", "card_type")], quality(cards).alias("q"))
    best = d.groupBy("component").agg(F.max_by(F.struct("pos", "title", "content", "reference", "card_type", "_row"), F.struct("q", "pos", "_row")).alias("b"), F.count("*").alias("n"))
    # a card without others meets nothing
    others = d.join(best.where("n > 1").select("component", "b"), "component").where("_row <> b._row").select("component", "pos", "title", "content", "reference", F.col("b.content").alias("canonical"))

    def run(batches):
        for b in batches:
            col = {n: b.column(n).to_pylist() for n in ("title", "content", "canonical")}
            extra = []
            for t, c, o in zip(col["title"], col["content"], col["canonical"]):
                s = unique_sentences(c, o, k)
                extra.append(f"【来自《{t}》的补充视角】\n" + "\n".join(s) if s else None)
            yield pa.RecordBatch.from_arrays([b.column("component"), b.column("pos"), b.column("reference"), pa.array(extra, pa.string())], names=["component", "pos", "reference", "extra"])

    found = others.mapInArrow(run, "component long, pos long, reference string, extra string")
    more = found.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("pos", "reference", "extra"))).alias("o"))
    all_ = best.join(more, "component", "left").withColumn("o", F.coalesce("o", F.array().cast("array<struct<pos:bigint,reference:string,extra:string>>")))
    extras = F.filter(F.transform("o", lambda x: x["extra"]), lambda x: x.isNotNull())
    refs = F.filter(F.array_distinct(F.concat(F.array("b.reference"), F.transform("o", lambda x: x["reference"]))), lambda x: x != "")
    return all_.select(
        F.col("b.pos").alias("pos"), F.concat("b.title", F.when(F.col("n") > 1, "(整合版)").otherwise("")).alias("title"),
        F.concat("b.content", F.when(F.size(extras) > 0, F.concat(F.lit("\n\n---\n\n"), F.array_join(extras, "\n\n"))).otherwise("")).alias("content"),
        F.col("b.card_type").alias("card_type"), F.array_join(refs, "; ").alias("reference"), F.col("n").alias("merged"),
    )


def dedup_cards(cards: DataFrame) -> DataFrame:
    """Cards after merging near-duplicates, with settings that follow the mean content length."""
    cards = written(_keyed(cards).withColumn("_row", F.monotonically_increasing_id()), "cards")
    k, threshold = settings(cards)
    edges = similarity_edges(cards.select(F.col("_row").alias("pos"), "title", "content"), k, threshold, spanning=True)
    return merge(cards, written(_labels(cards, edges, "_row"), "labels"), k)
