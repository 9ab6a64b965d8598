"""Exact substring dedup by longest-previous-factor arrays over bucketed suffix arrays.

A suffix at byte i is a copy if its longest previous factor, the longest match with a suffix that starts earlier
(in document order), has at least ``length`` bytes. In suffix order the candidates are the previous and the
next smaller position; a longest previous factor of at least ``length`` means that one of them lies in the same run of
neighbours with common prefixes of at least ``length``. ``keep="first"`` removes the bytes of copies and keeps
the first; ``keep="none"`` removes the bytes of every string of ``length`` bytes that starts anywhere else too.

How it is distributed. Each window of ``length`` bytes is given to the smallest hash (the anchor) of its 64-byte
strings, which depends on its bytes only, so equal windows meet at equal anchors. Consecutive windows with the same
anchor are one piece, about one per 130 bytes. Equal pieces are counted first, with map-side
pre-aggregation, so exact copies never meet in one task. Only anchors with several different pieces need suffix
order: one representative of each such piece is sent to the anchor's bucket, where a suffix array is built
by prefix doubling. A hot anchor's pieces are first cut down to the windows that can be copies at all: all its pieces are
sorted by the bytes on each side of the anchor (a range-partitioned sort, so no task holds the anchor), and a window
needs as many bytes on each side as the piece shares with a neighbour in that order. What is left is split into
chunks by its bytes, and the runs of the chunks are matched by window names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

LENGTH, GRAM = 400, 64
#: Windows of a text that are hashed at a time; bytes of pieces in one suffix array; pieces of an anchor in a chunk.
SEGMENT, BATCH, HOT = 1 << 18, 1 << 20, 1000
#: Two primes just under 2^32: products of residues fit an unsigned 64-bit word.
PRIMES, BASES = (4294967291, 4294967279), (2654435761, 3266489917)
MIX = np.uint64(0x9E3779B97F4A7C15)


class Names:
    """Names of substrings: 64 bits from polynomial hashes modulo two primes."""

    powers: list[tuple[np.ndarray, np.ndarray]] = []

    def __init__(self, data: np.ndarray):
        size = len(data) + 1
        if not Names.powers or len(Names.powers[0][0]) < size:
            Names.powers = [(self._powers(b, p, size), self._powers(pow(b, p - 2, p), p, size)) for b, p in zip(BASES, PRIMES)]
        x = data.astype(np.uint64) + np.uint64(1)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up[: len(x)] % np.uint64(p), dtype=np.uint64)]) for (up, _), p in zip(Names.powers, PRIMES)]

    @staticmethod
    def _powers(base: int, prime: int, size: int) -> np.ndarray:
        out, k, p = np.ones(size, np.uint64), 1, np.uint64(prime)
        while k < size:
            m = min(k, size - k)
            out[k : k + m] = out[:m] * (out[k - 1] * np.uint64(base) % p) % p
            k += m
        return out

    def half(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        p, sums = np.uint64(PRIMES[which]), self.sums[which]
        return (sums[end] - sums[start]) % p * Names.powers[which][1][start] % p

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.half(0, start, end) << np.uint64(32) | self.half(1, start, end)


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    rows = -(-len(v) // width)
    pad = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    pad[: len(v)] = v
    blocks = pad.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(v) - width + 1
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def pieces(data: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """For each segment of a text: anchor name, piece name, first window, number of windows, place of the anchor and repeats of its pieces.

    Equal pieces in a row, as in periodic text, are one with its number of repeats, so such a text has few rows.
    """
    whole = np.frombuffer(data, np.uint8)
    for base in range(0, len(whole) - length + 1, SEGMENT):
        x = whole[base : base + SEGMENT + length - 1]
        names = Names(x)
        at = np.arange(len(x) - gram + 1)
        hashed = names.half(0, at, at + gram) * MIX >> np.uint64(32)
        best = _sliding_min(hashed << np.uint64(32) | np.uint64(0xFFFFFFFF) - at.astype(np.uint64), length - gram + 1)
        anchor = (np.uint64(0xFFFFFFFF) - (best & np.uint64(0xFFFFFFFF))).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        n = np.diff(np.r_[first, len(anchor)])
        p = anchor[first]
        # equal pieces have the same bytes and the anchor at the same place
        name = names.of(first, first + n - 1 + length) ^ ((p - first).astype(np.uint64) << np.uint64(16) | n.astype(np.uint64)) * MIX
        new = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (n[1:] != n[:-1])])
        yield names.of(p, p + gram)[new], name[new], first[new] + base, n[new], (p - first)[new], np.diff(np.r_[new, len(name)])


def suffix_ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix by its first ``depth`` bytes (equal ranks: equal prefixes), by prefix doubling."""
    n = len(data)
    rank, have = data.astype(np.int64) + 1, 1
    while have < depth:
        step = min(have, depth - have)  # the last step may overlap: it compares exactly ``depth`` bytes
        after = np.zeros(n, np.int64)
        after[: max(n - step, 0)] = rank[step:]
        rank = np.unique(rank * (rank.max(initial=0) + 1) + after, return_inverse=True)[1] + 1
        have += step
    return rank


def previous_factors(rank: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In suffix order, where equal ``rank`` marks a run with common prefixes of the wanted length:
    (order, run number, whether the previous or the next smaller position lies in the same run)."""
    order = np.argsort(rank, kind="stable")
    run = np.cumsum(np.r_[0, rank[order][1:] != rank[order][:-1]]) if len(order) else order
    pos = position[order]
    far = np.int64(pos.max(initial=0)) + 1
    smaller_before = np.minimum.accumulate(pos - run * far) + run * far < pos
    smaller_after = (np.minimum.accumulate((pos + run * far)[::-1])[::-1] - run * far) < pos
    return order, run, smaller_before | smaller_after


def bucket(texts: list[bytes], keys: np.ndarray, position: np.ndarray, hot: np.ndarray, keep: str, length: int = LENGTH):
    """One suffix array over the pieces of some buckets (``keys`` tells which).

    ``position`` orders the pieces' first windows. Returns the windows that are copies, as (piece, first, last) runs, and for hot
    buckets the first window of every run, as (piece, window, name).
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes) - sizes
    n = sizes - length + 1
    piece = np.repeat(np.arange(len(texts)), n)
    window = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    at = starts[piece] + window
    rank = suffix_ranks(data, length)[at]
    rank = rank + keys[piece] * np.int64(len(data) + 2)  # runs never join two buckets
    # windows of pieces in document order: (position of the piece, window)
    place = position[piece] * np.int64(window.max(initial=0) + 1) + window
    order, run, earlier = previous_factors(rank, place)
    if keep == "first":
        hit = earlier
    else:
        size = np.bincount(run)
        hit = size[run] > 1
    flagged = np.zeros(len(piece), bool)
    flagged[order] = hit
    edge = np.r_[True, (piece[1:] != piece[:-1]) | (flagged[1:] != flagged[:-1])] if len(piece) else np.zeros(0, bool)
    lo = np.flatnonzero(edge)
    hi = np.r_[lo[1:], len(piece)] - 1
    take = flagged[lo]
    lo, hi = lo[take], hi[take]
    first = order[~earlier]
    first = first[hot[piece[first]]]
    names = Names(data).of(at[first], at[first] + length) if len(first) else np.zeros(0, np.uint64)
    return (piece[lo], window[lo], window[hi]), (piece[first], window[first], names)


def _keyed(docs: DataFrame, *more) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(*more, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_d"), F.xxhash64(text).alias("_h"), text.alias("_t"))


BYTES_NAMES = ["anchor", "chunk", "_d", "_h", "at", "o", "bytes"]
BYTES_KINDS = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
BYTES_SCHEMA = "anchor long, chunk int, _d long, _h long, at long, o int, bytes binary"


def common_prefix(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _cut_down(rows: DataFrame, length: int) -> DataFrame:
    """Pieces of hot anchors without windows that cannot be copies; ``chunk`` is the number of chunks, then the chunk."""

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in (big.slice(at, 2000) for at in range(0, big.num_rows, 2000)):
                o, data = b.column(5).to_pylist(), b.column(6).to_pylist()
                for side, ctx in ((0, [x[:k][::-1] for x, k in zip(data, o)]), (1, [x[k:] for x, k in zip(data, o)])):
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array([side] * b.num_rows, pa.int32()), pa.array(ctx, pa.binary()), *b.columns[2:5]], names=["anchor", "side", "ctx", "_d", "_h", "at"])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the first and the last row of a task do not see one neighbour; they keep all they have
        before: tuple | None = None  # anchor, side, ctx, _d, _h, at, most so far
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if before is None:
                    shared = len(row[2])
                else:
                    shared = common_prefix(before[2], row[2]) if before[:2] == row[:2] else 0
                    out.append((*before[3:6], before[0], before[1], max(before[6], shared)))
                before = (*row, shared)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["_d", "_h", "at", "anchor", "side", "most"])
        if before is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*before[3:6], before[0], before[1], len(before[2]))], names=["_d", "_h", "at", "anchor", "side", "most"])

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for anchor, chunks, d, h, at, o, data, left, right in zip(*(c.to_pylist() for c in b.columns)):
                lo, hi = max(0, o - left), min(len(data) - length, o - length + right)
                if lo <= hi:
                    part = data[lo : hi + length]
                    out.append((anchor, zlib.crc32(part) % chunks, d, h, at + lo, o - lo, part))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 7, BYTES_KINDS)], names=BYTES_NAMES)

    ctx = rows.mapInArrow(sides, "anchor long, side int, ctx binary, _d long, _h long, at long")
    most = ctx.repartitionByRange("anchor", "side", "ctx").sortWithinPartitions("anchor", "side", "ctx").mapInArrow(neighbours, "_d long, _h long, at long, anchor long, side long, most long")
    limits = most.groupBy("_d", "_h", "at", "anchor").agg(F.max(F.when(F.col("side") == 0, F.col("most"))).alias("left"), F.max(F.when(F.col("side") == 1, F.col("most"))).alias("right"))
    return rows.join(limits, ["_d", "_h", "at", "anchor"]).select(*BYTES_NAMES, "left", "right").mapInArrow(trim, BYTES_SCHEMA)


def repeated(docs: DataFrame, keep: str = "none", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(_d, _h, spans array<struct<lo, hi>>): the byte ranges to remove, for each document that has any.

    A document is told by its id and the hash of its text, so rows with one id and different texts are apart.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    last = length - 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in (big.slice(at, 200) for at in range(0, big.num_rows, 200)):
                d, h = b.column(0).to_numpy(), b.column(1).to_numpy()
                got = [(i, *p) for i, t in enumerate(b.column(2).cast(pa.binary()).to_pylist()) for p in pieces(t, length, gram)]
                if not got:
                    continue
                row = np.repeat([g[0] for g in got], [len(g[1]) for g in got])
                anchor, piece, at, n, o, times = (np.concatenate([g[k] for g in got]) for k in (1, 2, 3, 4, 5, 6))
                cols = (anchor.view(np.int64), piece.view(np.int64), d[row], h[row], at, n.astype(np.int32), o.astype(np.int32), times.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["anchor", "piece", "_d", "_h", "at", "n", "o", "times"])

    keyed = _keyed(docs)
    each = written(keyed.mapInArrow(cut, "anchor long, piece long, _d long, _h long, at long, n int, o int, times int"), "pieces")
    kinds = written(each.groupBy("anchor", "piece").agg(F.sum("times").alias("copies"), F.min(F.struct("_d", "_h", "at")).alias("rep"), F.first("n").alias("n"), F.first("o").alias("o")), "kinds")

    # 1. copies of whole pieces
    many = kinds.where("copies > 1").select("anchor", "piece", "rep")
    copies = each.join(many, ["anchor", "piece"])
    lo, end = F.col("at"), F.col("at") + F.col("n") * F.col("times")
    if keep == "first":  # of a run of equal pieces that begins with the first one, only the others go
        lo = F.when(F.struct("_d", "_h", "at") == F.col("rep"), F.col("at") + F.col("n")).otherwise(F.col("at"))
    spans = copies.select("_d", "_h", lo.alias("lo"), end.alias("end")).where("lo < end").select("_d", "_h", "lo", (F.col("end") + last).alias("hi"))

    # 2. anchors with different pieces: their representatives meet in suffix order
    mixed = written(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "mixed")
    blocks = F.when(F.col("kinds") > hot, F.ceil(F.col("kinds") / hot)).otherwise(-1).cast("int")
    meet = kinds.join(mixed, "anchor").select(F.col("rep._d").alias("_d"), F.col("rep._h").alias("_h"), F.struct("rep.at", "n", "o", "anchor", blocks.alias("chunk")).alias("p"))
    wanted = written(meet.groupBy("_d", "_h").agg(F.collect_list("p").alias("ps")), "wanted")

    def lift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in (big.slice(at, 100) for at in range(0, big.num_rows, 100)):
                out = []
                for d, h, t, ps in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist()):
                    out += [(p["anchor"], p["chunk"], d, h, p["at"], p["o"], t[p["at"] : p["at"] + p["n"] + last]) for p in ps]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), BYTES_KINDS)], names=BYTES_NAMES)

    # repeated rows of a document are one here
    texts = keyed.join(wanted, ["_d", "_h"]).select("_d", "_h", "_t", "ps")
    bytes_ = texts.mapInArrow(lift, BYTES_SCHEMA)
    if not mixed.where(F.col("kinds") > hot).isEmpty():
        bytes_ = written(bytes_, "bytes")
        bytes_ = bytes_.where("chunk < 0").unionByName(_cut_down(bytes_.where("chunk >= 0"), length))
    bytes_ = bytes_.drop("o")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def done() -> pa.RecordBatch:
            seen = sorted(set(rows))
            ids = {k: i for i, k in enumerate(dict.fromkeys((r[0], r[1]) for r in seen))}
            keys = np.array([ids[r[0], r[1]] for r in seen], np.int64)
            place = np.zeros(len(seen), np.int64)
            place[sorted(range(len(seen)), key=lambda i: seen[i][2:5])] = np.arange(len(seen))
            # overlapping windows of two pieces of one document are in the same order as their pieces' starts
            spans, firsts = bucket([r[5] for r in seen], keys, place, np.array([r[1] >= 0 for r in seen], bool), keep, length)
            out = [(seen[i][2], seen[i][3], seen[i][4] + lo, seen[i][4] + hi, None, None) for i, lo, hi in zip(*(x.tolist() for x in spans))]
            out += [(seen[i][2], seen[i][3], seen[i][4] + w, seen[i][4] + w, seen[i][0], name) for i, w, name in zip(firsts[0].tolist(), firsts[1].tolist(), firsts[2].view(np.int64).tolist())]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 6)], names=["_d", "_h", "first", "last", "anchor", "name"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if size > BATCH and row[:2] != rows[-1][:2]:
                    yield done()
                    rows.clear()
                    size = 0
                rows.append(row)
                size += len(row[5])
        if rows:
            yield done()

    dealt = bytes_.repartition("anchor", "chunk").sortWithinPartitions("anchor", "chunk")
    found = written(dealt.mapInArrow(sort, "_d long, _h long, first long, last long, anchor long, name long"), "found")
    spans = spans.unionByName(found.where("name is null").select("_d", "_h", F.col("first").alias("lo"), (F.col("last") + length).alias("hi")))

    # 3. hot anchors: the first windows of the chunks' runs, matched by name
    runs = found.where("name is not null").select("_d", "_h", "first", "anchor", "name")
    if not runs.isEmpty():
        head = runs.groupBy("anchor", "name").agg(F.count("*").alias("runs"), F.min(F.struct("_d", "_h", "first")).alias("head")).where("runs > 1")
        again = runs.join(head, ["anchor", "name"])
        if keep == "first":
            again = again.where(F.struct("_d", "_h", "first") != F.col("head"))
        spans = spans.unionByName(again.select("_d", "_h", F.col("first").alias("lo"), (F.col("first") + length).alias("hi")))
    return spans.groupBy("_d", "_h").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def merge(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def remaining(data: bytes, gone: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in gone for x in s), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def removal(docs: DataFrame, keep: str = "none", length: int = LENGTH, **tuning) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, text, spans for each row of ``docs(doc_id, text)``.

    ``text`` is what remains (bytes of a character that is cut in two are left out there), ``spans`` the removed byte ranges.
    A null text counts as empty; texts under ``length`` bytes keep all. Repeated rows are one row here, with the
    same result each; rows with a null doc_id are told apart by their text. Other columns are ignored.
    """
    rows = _keyed(docs, F.col("doc_id").cast("long").alias("doc_id")).join(repeated(docs, keep, length, **tuning), ["_d", "_h"], "left").select("doc_id", "_t", "spans")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "spans"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, t, s in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
                gone = merge(s)
                left = remaining(t, gone) if gone else t
                out.append((i, len(t), sum(y - x for x, y in gone), len(gone), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore"), [{"lo": x, "hi": y} for x, y in gone]))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 7, kinds)], names=names)

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, spans array<struct<lo:long,hi:long>>")


def without_copies(docs: DataFrame, keep: str = "first", length: int = LENGTH, min_words: int = 0, **tuning) -> DataFrame:
    """``docs`` with the copies cut out of ``text`` (and n_chars, if there, brought up to date); columns and rows stay.

    A copied stretch goes if it has at least ``length`` bytes and ``min_words`` words. Bytes of a character that is cut in two are
    dropped with it. A null text stays null. Rows count by themselves: of repeated rows (one doc_id, one text) the
    first in the table's order counts as the earliest with ``keep="first"``, and the others lose all that is long enough.
    """
    again = None
    if keep == "first":
        keys = _keyed(docs).groupBy("_d", "_h").agg(F.count("*").alias("n")).where("n > 1").select("_d", "_h")
        if not keys.isEmpty():
            docs = written(docs.withColumn("_r", F.monotonically_increasing_id()), "rows")
            again = _keyed(docs, "_r").groupBy("_d", "_h").agg(F.count("*").alias("n"), F.min("_r").alias("_first")).where("n > 1").drop("n")
    columns = [c for c in docs.columns if again is None or c != "_r"]
    rows = _keyed(docs, F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col("_r") if again is not None else F.lit(0).alias("_r"))
    rows = rows.join(repeated(docs, keep, length, **tuning), ["_d", "_h"], "left")
    repeat = F.lit(False)
    if again is not None:
        rows = rows.join(again, ["_d", "_h"], "left")
        repeat = F.coalesce(F.col("_r") != F.col("_first"), F.lit(False))
    rows = rows.select("_row", "_t", "spans", repeat.alias("_again"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = []
            for t, s, whole in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                gone = [(0, len(t))] if whole and len(t) >= length else merge(s)
                gone = [(x, y) for x, y in gone if not min_words or len(t[x:y].split()) >= min_words]
                left.append(remaining(t, gone).decode("utf-8", "ignore") if gone else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(left, pa.string())], names=["_row", "_left"])

    got = rows.mapInArrow(run, rows.select("_row").schema.add("_left", "string"))
    cut = F.col("_left").isNotNull()
    new = {"text": F.when(cut, F.col("_left")).otherwise(F.col("_row.text")), "n_chars": F.when(cut, F.length("_left").cast("long")).otherwise(F.col("_row.n_chars")) if "n_chars" in columns else None}
    return got.select(*[new[c].alias(c) if c in new else F.col(f"_row.`{c}`") for c in columns])
