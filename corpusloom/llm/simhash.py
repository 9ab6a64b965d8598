"""Near-duplicate detection on SimHash fingerprints by anchor-point covering.

Method. A 64-bit fingerprint is two halves of 32 bits. Two fingerprints that differ in at most
three bits agree in one half up to one bit. For each half the anchors are the codewords of the
perfect Hamming code of length 31 (the 32nd bit is free): a covering code of radius 1, so each half
has one home anchor at distance 0 or 1. A fingerprint is sent to every anchor within covering radius
plus threshold, 1 + 1 = 2 bits of its half: 17 anchors at most. Of a linked pair the one is at home at
an anchor that the other one also reaches, so comparing per anchor misses no link.

Copies are one fingerprint: they are grouped before anything is replicated. Within an anchor the links
are found with spanning edges only, never all pairs. An anchor at which many fingerprints are at home
is split into a grid of blocks, so no task has to hold a hot anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_copies
from .common import connected_components, small_or_plain, written

SEED, SHINGLE, MAX_BITS = 42, 3, 3
#: An anchor with more fingerprints at home than this is split into blocks of about this size.
HOT_ANCHOR = 4096
#: Groups up to this size are compared pair by pair, larger ones by a search that emits spanning edges.
SMALL_GROUP = 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned SimHash of a whole UTF-8 text; a text without words (or null) has 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    total, counts = len(words) - shingle + 1, np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, total, 1 << 16):  # bounded memory for very long texts
        part = [digest(join(words[i : i + shingle]), seed) for i in range(at, min(total, at + (1 << 16)))]
        counts += np.unpackbits(np.array(part, dtype=">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x) for x in b.column(1).cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _syndromes() -> np.ndarray:
    """For each byte of a half and its value: the XOR of (position + 1) over its set bits; bit 31 is free."""
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for value in range(256):
            for bit in range(8):
                if value >> bit & 1 and byte * 8 + bit < 31:
                    out[byte, value] ^= byte * 8 + bit + 1
    return out


SYNDROME = _syndromes()
#: For each syndrome 1..31 the 15 pairs of bits whose flip leads to a codeword at distance 2.
PAIRS = np.array([[0] * 15] + [[(1 << i - 1) | (1 << (i ^ s) - 1) for i in range(1, 32) if i < (i ^ s)] for s in range(1, 32)], dtype=np.uint64)


def home_anchor(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest codeword of each 32-bit half, and the half's syndrome."""
    s = np.zeros(len(half), np.uint32)
    for byte in range(4):
        s ^= SYNDROME[byte, (half >> np.uint64(8 * byte)) & np.uint64(255)]
    flip = np.where(s > 0, np.uint64(1) << np.maximum(s.astype(np.uint64), np.uint64(1)) - np.uint64(1), np.uint64(0))
    return half ^ flip, s


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For unsigned fingerprints: (index, anchor key, at home) for every anchor within radius + threshold."""
    index, keys, homes = [], [], []
    every = np.arange(len(fp))
    for side in (0, 1):
        half = (fp >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)
        home, s = home_anchor(half)
        tag = np.uint64(side << 32)
        odd = np.flatnonzero(s > 0)
        near = (half[odd, None] ^ PAIRS[s[odd]]).ravel()
        for i, k, h in ((every, home, True), (every, home ^ np.uint64(1 << 31), False), (np.repeat(odd, 15), near, False)):
            index.append(i)
            keys.append(k | tag)
            homes.append(np.full(len(i), h))
    return np.concatenate(index), np.concatenate(keys), np.concatenate(homes)


def _spanning(fp: np.ndarray, home: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges that connect what is linked within one anchor's group; each row is reached once."""
    left, out = np.arange(len(fp)), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            hit = np.bitwise_count(fp[left] ^ fp[at]) <= most
            if not home[at]:
                hit &= home[left]
            found = left[hit]
            out += [(at, x) for x in found]
            front += list(found)
            left = left[~hit]
    return out


def _edges(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, home: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of representatives for rows that are sorted by anchor."""
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]) if len(key) else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, len(key)])
    group = np.repeat(np.arange(len(starts)), sizes)
    a, b = [], []
    small = sizes[group] <= SMALL_GROUP
    for step in range(1, int(min(SMALL_GROUP, sizes.max(initial=1)))):
        i = np.flatnonzero((group[step:] == group[:-step]) & small[step:])
        i = i[(home[i] | home[i + step]) & (np.bitwise_count(fp[i] ^ fp[i + step]) <= most)]
        a.append(rep[i])
        b.append(rep[i + step])
    for g in np.flatnonzero(sizes > SMALL_GROUP):
        sl = slice(starts[g], starts[g] + sizes[g])
        if pairs := _spanning(fp[sl], home[sl], most):
            i = np.array(pairs) + starts[g]
            a.append(rep[i[:, 0]])
            b.append(rep[i[:, 1]])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def links(distinct: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT_ANCHOR) -> DataFrame:
    """Edges (a, b) between representatives of ``distinct(fp, rep)`` that connect all fingerprints within ``max_bits``.

    Exact for ``max_bits`` up to 3.
    """
    if max_bits > 3:
        raise ValueError("two halves with covering radius 1 reach three differing bits")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 20_000):
                b = big.slice(at, 20_000)
                i, key, home = anchors(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(0).take(pa.array(i)), b.column(1).take(pa.array(i)), pa.array(home)], names=["anchor", "fp", "rep", "home"])

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            key = np.concatenate([home_anchor((fp >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF))[0] | np.uint64(side << 32) for side in (0, 1)])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["anchor"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for b in batches:
            key = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 2)], axis=1)
            cols = [key, b.column(3).to_numpy(zero_copy_only=False).view(np.uint64), b.column(4).to_numpy(zero_copy_only=False), b.column(5).to_numpy(zero_copy_only=False)]
            if kept is not None:
                cols = [np.concatenate(x) for x in zip(kept, cols)]
            if not len(cols[0]):
                continue
            last = int(np.flatnonzero((cols[0] == cols[0][-1]).all(axis=1))[0])  # the last group may go on
            kept = [x[last:] for x in cols]
            x, y = _edges(*[c[:last] for c in cols], max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])
        if kept is not None:
            x, y = _edges(*kept, max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    distinct = distinct.select("fp", "rep")
    rows = distinct.mapInArrow(spread, "anchor long, fp long, rep long, home boolean")
    busy = written(
        distinct.mapInArrow(homes, "anchor long").groupBy("anchor").count().where(F.col("count") > hot).select("anchor", F.ceil(F.col("count") / hot).cast("int").alias("blocks")),
        "hot_anchors",
    )
    if busy.isEmpty():
        rows = rows.withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    else:
        # home rows go to all blocks of one line of the grid, the others to all blocks of one column
        mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        every = F.sequence(F.lit(0), F.col("blocks") - 1)
        rows = rows.join(small_or_plain(busy), "anchor", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        as_home = rows.where("home").select("anchor", mine.alias("i"), F.explode(every).alias("j"), "fp", "rep", F.lit(True).alias("home"))
        as_other = rows.where("not home or blocks > 1").select("anchor", F.explode(every).alias("i"), mine.alias("j"), "fp", "rep", F.lit(False).alias("home"))
        rows = as_home.unionByName(as_other)
    return rows.select("anchor", "i", "j", "fp", "rep", "home").repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs(doc_id, text)``; other columns are ignored.

    A null or empty text, or one without words, has fingerprint zero and is linked like any other. Repeated rows stay. A
    row with a null doc_id keeps its row and links like any other; it gets the smallest doc_id that is
    reachable, null if there is none. An empty table gives an empty result.
    """
    each = written(fingerprints(docs), "fingerprints")
    # components run on fingerprints, so that rows with a null id take part
    distinct = written(each.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    comp = connected_components(links(distinct.select("fp", F.col("fp").alias("rep"))))
    label = distinct.join(comp, distinct.fp == comp.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("c"))
    least = label.groupBy("c").agg(F.min("low").alias("component_id"))
    label = label.join(least, "c").select("fp", "component_id")
    return each.join(label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = near_copies.SHINGLE, similarity: float = near_copies.SIMILARITY) -> DataFrame:
    """One row of each group of near copies: word shingles with a Jaccard similarity of at least ``similarity``.

    Anchor-point covering proposes the pairs whose fingerprints (of the shingle sets) differ in at most three bits, and
    whole shingle sets decide. At a similarity of 0.8 fingerprints differ by ten bits on average, far beyond any covering
    radius that stays selective, so MinHash bands propose what is still apart. Which row of a group stays, and null, empty
    and repeated rows: see ``near_copies.keep_one``.
    """

    def propose(nodes: DataFrame) -> DataFrame:
        distinct = written(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "distinct")
        same = nodes.join(distinct, "fp").where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
        return same.unionByName(links(distinct))

    return near_copies.keep_one(docs, shingle, similarity, propose)
