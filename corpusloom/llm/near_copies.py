"""Near copies by the Jaccard similarity of word shingles: candidates by fingerprint or MinHash band, whole shingle sets for the verdict.

Texts with the same words are one node. A node is filed under BANDS keys, each made of ROWS minima of its shingle
hashes; a pair of similarity s shares no key with probability (1 - s^ROWS)^BANDS, 3.2e-6 at 0.8 and less above.
Pairs that share a key are linked if their similarity, from all shingles of both, reaches the threshold.

Not all pairs under a key are compared: only what connects. Each node is compared with a pivot of its key (and with what the
caller proposes) and once more with another pivot. The nodes whose keys still hold several components then go through an exact
set join with prefix and position filters on the shingles that components share. So a large group of near copies makes edges in
proportion to its size, many texts around one hub make no pairs, and no pair that could join two components is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard
from .common import connected_components, small_or_plain, written

SEED, SHINGLE, SIMILARITY = 42, 5, 0.8
BANDS, ROWS = 24, 4
#: Rounds with a pivot for each key, before the set join of what is still apart.
PIVOTS = 2
#: Shingles of a text whose minima are taken at a time.
SEGMENT = 4096
#: A set's bitmap has two to this power of bits.
BITMAP_LOG = 9
MIX = np.uint64(0x9E3779B97F4A7C15)
FACTORS = np.random.default_rng(SEED).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def shingle_set(of: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles; a shorter text is its only shingle."""
    each = np.array([xxhash.xxh64_intdigest(w, SEED) for w in of], dtype=np.uint64)
    size = min(shingle, len(each))
    if not size:
        return each
    out = np.zeros(len(each) - size + 1, np.uint64)
    for k in range(size):
        out = (out + each[k : k + len(out)]) * MIX
    return np.unique(_mixed(out))


def set_fingerprint(found: np.ndarray) -> int:
    """The SimHash of a shingle set: a bit is 1 if it is set in over half the hashes; 0 for no words."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 16):
        counts += np.unpackbits(found[at : at + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(found)).tobytes(), "big")


def band_keys(found: np.ndarray) -> np.ndarray:
    if not len(found):
        return found
    low = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), SEGMENT):
        low = np.minimum(low, (found[at : at + SEGMENT, None] * FACTORS).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for part in _mixed(low).reshape(BANDS, ROWS).T:
        key = _mixed((key + part) * MIX)
    return key


def bitmap(found: np.ndarray) -> np.ndarray:
    """A bitmap, each bit the parity of the shingles hashed to it: two sets differ in at least as many shingles as bits."""
    return np.packbits((np.bincount((found >> np.uint64(64 - BITMAP_LOG)).astype(np.int64), minlength=1 << BITMAP_LOG) & 1).astype(np.uint8)).view(np.int64)


def _sketches(rows: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [words(x) for x in b.column(3).cast(pa.binary()).to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED) for w in each], dtype=np.uint64).view(np.int64)
            keys, fps, sizes = [], [], []
            for w in each:
                found = shingle_set(w, shingle)
                keys.append(band_keys(found).view(np.int64))
                fps.append(set_fingerprint(found))
                sizes.append(len(found))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(node), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["_row", "_d", "_h", "node", "fp", "n", "keys"])

    text = F.col("text").cast("string")
    return rows.select("_row", F.col("doc_id").cast("long").alias("_d"), F.xxhash64(text).alias("_h"), text.alias("_t")).mapInArrow(run, "_row long, _d long, _h long, node long, fp long, n long, keys array<long>")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(words(x), shingle) for x in b.column(1).cast(pa.binary()).to_pylist()]
            lists = [pa.array([f(x) for x in found], pa.list_(pa.int64())) for f in (lambda x: x.view(np.int64), bitmap)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], names=["node", "set", "bits"])

    return texts.select("node", F.col("text").cast("string")).mapInArrow(run, "node long, set array<long>, bits array<long>")


def _prefix_pairs(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) in different components among ``nodes(node, n, c)``: a superset of the similar ones, by prefix filter.

    The shingles of all sets have one order: those that only one component has (narrow), then the others (wide) from rare
    to frequent. Two sets of that similarity share a shingle among the first n - ceil(similarity * n) + 1 of each, and at
    the first one that they share enough must be left in both. Narrow ones join nothing, so only wide ones are posted.
    Texts that have most shingles from one hub still meet under those; there the join's condition compares bitmaps, which
    tell at least how many shingles two sets do not share, so what is not similar is hardly ever given out by the join.
    """
    shingles = nodes.join(sets, "node").select("node", "c", "n", F.explode("set").alias("token"))
    wide = written(shingles.groupBy("token").agg(F.count("*").alias("df"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("token", "df"), "wide")
    each = shingles.join(small_or_plain(wide), "token").groupBy("node", "c", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("w"))
    narrow = F.col("n") - F.size("w")
    first = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1
    posted = each.withColumn("narrow", narrow).where(first > narrow).select("node", "c", "n", "narrow", F.posexplode(F.slice("w", F.lit(1), (first - narrow).cast("int"))).alias("at", "w"))
    # what a set has left from this shingle on, itself included
    posted = written(posted.select(F.col("w.token").alias("token"), "node", "c", "n", (F.col("n") - F.col("narrow") - F.col("at")).alias("left")), "posted")
    posted = posted.join(sets.select("node", "bits"), "node")
    x, y = posted.alias("x"), posted.alias("y")
    enough = F.least("x.left", "y.left") >= (F.col("x.n") + F.col("y.n")) * (similarity / (1 + similarity)) - 1e-9
    unlike = reduce(Column.__add__, [F.bit_count(F.col("x.bits")[k].bitwiseXOR(F.col("y.bits")[k])) for k in range((1 << BITMAP_LOG) // 64)])
    enough &= unlike <= (F.col("x.n") + F.col("y.n")) * ((1 - similarity) / (1 + similarity)) + 1e-9
    return x.join(y, F.expr("x.token = y.token and x.node < y.node and x.c <> y.c") & enough).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _components(shared: DataFrame, sets: DataFrame, similarity: float, proposed: DataFrame | None = None) -> DataFrame | None:
    """(node, component) of the nodes that are linked under the keys of ``shared(key, node, n)`` or as ``proposed(a, b)``.

    ``n`` is the size of a node's set: sets whose sizes differ too much cannot be similar and are not compared.
    """

    def alike(x: str, y: str) -> Column:
        return F.least(x, y) >= similarity * F.greatest(x, y)


    def linked(pairs: DataFrame, k: int) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
        return written(pairs.join(left, "a").join(right, "b").where(jaccard(F.col("sa"), F.col("sb")) >= similarity).select("a", "b"), f"links{k}")

    edges, comp = [], None
    for k in range(PIVOTS + 1):
        if comp is None:
            now = shared.withColumn("c", F.col("node"))
        else:
            now = shared.join(comp, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("c"))
        # a key whose nodes are in one component has nothing left to link
        apart = now.groupBy("key").agg(F.min_by(F.struct("node", "c", "n"), F.xxhash64("node", F.lit(k))).alias("p"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
        now = written(now.join(apart.select("key", "p"), "key"), f"apart{k}")
        if now.isEmpty() and (k or proposed is None):
            break
        if k < PIVOTS:
            pairs = now.where(F.expr("c <> p.c") & alike("n", "p.n")).select(F.col("node").alias("a"), F.col("p.node").alias("b"))
            if not k and proposed is not None:
                pairs = pairs.unionByName(proposed.select("a", "b"))
        else:
            pairs = _prefix_pairs(now.groupBy("node").agg(F.first("n").alias("n"), F.first("c").alias("c")), sets, similarity)
        found = linked(pairs, k)
        if found.isEmpty():
            continue
        edges.append(found)
        comp = written(connected_components(reduce(DataFrame.unionByName, edges)), f"components{k}")
    return comp


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, propose: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row of each group of rows that are linked by similarities of at least ``similarity``.

    ``propose`` may give pairs (a, b) of ``nodes(node, fp)`` that are compared first; the bands find what is left.

    The row with the smallest doc_id stays (null is the largest; of one doc_id the one with the smallest hash of
    its text). Rows count by themselves, so repeated rows and repeated or null ids are told apart. Words are
    split at ASCII space and compared without ASCII case; texts without words, or null, are copies of each other.
    """
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    each = written(_sketches(rows, shingle), "sketches")
    nodes = each.groupBy("node").agg(F.min(F.struct("_row", "fp", "n", "keys")).alias("rep")).select("node", "rep.*")
    filed = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = written(filed.join(filed.groupBy("key").agg(F.count("*").alias("many")).where("many > 1"), "key").select("key", "node", "n"), "shared")
    asked, proposed = shared.select("node"), None
    if propose is not None:
        proposed = written(propose(nodes.select("node", "fp")), "proposed")
        asked = asked.unionByName(proposed.select(F.explode(F.array("a", "b")).alias("node")))
    wanted = written(nodes.select("node", "_row").join(asked.distinct(), "node"), "wanted")
    sets = written(_sets(rows.join(small_or_plain(wanted), "_row"), shingle), "sets")
    comp = _components(shared, sets, similarity, proposed)
    rank = F.struct(F.col("_d").isNull().alias("none"), "_d", "_h", "_row")
    each = each.select("_row", "node", rank.alias("rank"))
    if comp is None:
        each = each.withColumn("c", F.col("node"))
    else:
        each = each.join(comp, "node", "left").select("_row", "rank", F.coalesce("component", "node").alias("c"))
    best = each.groupBy("c").agg(F.count("*").alias("n"), F.min("rank").alias("best")).where("n > 1")
    drop = written(each.join(best, "c").where("_row <> best._row").select("_row"), "drop")
    return rows.join(small_or_plain(drop), "_row", "left_anti").select(*docs.columns)
