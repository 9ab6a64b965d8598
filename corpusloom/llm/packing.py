"""Best-fit packing of documents into sequences, after Martello-Toth dominance reduction.

Bin packing needs only how many pieces there are of each length, a histogram of at most ``capacity``
entries however large the corpus. On this histogram, with multiplicities:

1. reduction: for each length, longest first, a small set that provably dominates every other way to fill
   the rest of its sequence is fixed for good: alone if nothing else fits; with the longest partner if that
   fills the sequence or if no two others fit; with two partners if no three others fit and no feasible pair
   has a longer second piece. This keeps the optimum;
2. best fit, longest first, packs what is left.

The plan is a list of patterns (lengths that share a sequence) with counts. Each step uses up a length
or a pattern's remaining count, so the number of patterns follows the capacity and not the corpus, and
the plan can be broadcast. A piece finds its place from its rank among the pieces of its length: the rank
within its task is stored with the piece, and a prefix sum over tasks makes it global.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .tokens import END_ID, default_ranks_path, encoder

CAPACITY = 1024
#: Texts that are tokenized at a time within a batch.
CHUNK = 64

Plan = list[tuple[tuple[int, ...], int]]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first one may be shorter than ``capacity``."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * (first > 0) + [(s, capacity) for s in range(first, n, capacity)]


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[Plan, dict[int, int]]:
    """Patterns that some optimal packing has, and the counts that are left."""
    left = {k: v for k, v in counts.items() if v > 0}
    fixed: Plan = []

    def fix(pattern: tuple[int, ...], times: int) -> None:
        fixed.append((pattern, times))
        for x in pattern:
            left[x] -= times
        for x in set(pattern):
            if not left[x]:
                del left[x]

    def times(pattern: tuple[int, ...]) -> int:
        return min(left.get(x, 0) // pattern.count(x) for x in set(pattern))

    changed = True
    while changed:
        changed = False
        for longest in sorted(left, reverse=True):
            while left.get(longest, 0):
                lengths = sorted(left)
                rest = capacity - longest
                # the others, without one piece of this length; three smallest with their multiplicity
                others = [x for x in lengths if x != longest or left[x] > 1]
                few: list[int] = []
                for x in others[:4]:
                    few += [x] * min(3, left[x] - (x == longest))
                if not few or few[0] > rest:
                    fix((longest,), left[longest])
                    changed = True
                    continue
                k = others[bisect_right(others, rest) - 1]
                one, two = sum(few[:2]) > rest or len(few) < 2, sum(few[:3]) > rest or len(few) < 3
                if k == rest or one:
                    if n := times((longest, k)):  # what holds once holds n times: the smallest others only grow
                        fix((longest, k), n)
                        changed = True
                        continue
                if two and k != longest:
                    rest2 = rest - k
                    second = [x for x in others if x <= rest2 and left[x] - (x == k) - (x == longest) > 0]
                    b = second[-1] if second else 0
                    small = [x for x in others if 2 * x <= rest]
                    if b and (not small or small[-1] <= b) and (n := times((longest, k, b))):
                        fix((longest, k, b), n)
                        changed = True
                        continue
                break
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit, longest first, on counts: each piece goes to the fullest open sequence that still holds it."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rests: list[int] = []

    def put(rest: int, pattern: tuple[int, ...], times: int) -> None:
        if times:
            if rest not in open_:
                open_[rest] = []
                rests.insert(bisect_left(rests, rest), rest)
            open_[rest].append((pattern, times))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(rests, length)
            if at == len(rests):
                rest, pattern, m = capacity, (), n
            else:
                rest = rests[at]
                pattern, m = open_[rest].pop()
                if not open_[rest]:
                    del open_[rest], rests[at]
            each = rest // length  # a sequence that got one piece is the fullest now and gets the next
            used = min(m, n // each)
            if used:
                put(rest - each * length, pattern + (length,) * each, used)
                n -= used * each
            elif n:
                put(rest - n * length, pattern + (length,) * n, 1)
                used, n = 1, 0
            if rest != capacity or pattern:
                put(rest, pattern, m - used)
    return [x for rest in open_.values() for x in rest]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    fixed, left = reduce_instance(counts, capacity)
    return fixed + best_fit(left, capacity)


def places(patterns: Plan) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank of each run of ranks, first sequence of the run, and the offset in the sequence."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    seen: dict[int, int] = {}
    base = 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            runs.setdefault(length, []).append((seen.get(length, 0), base, offset))
            seen[length] = seen.get(length, 0) + times
            offset += length
        base += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in runs.items()}


def pieces(docs: DataFrame, capacity: int = CAPACITY, ranks_path: str | None = None) -> DataFrame:
    """(part, nth, doc_id, piece, start, length, ids_crc32); nth counts the pieces of a length within a task."""
    path = ranks_path or default_ranks_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), encoder(path).encode_ordinary
        seen = np.zeros(capacity + 1, np.int64)
        for big in batches:
            for at in range(0, big.num_rows, CHUNK):
                b, rows = big.slice(at, CHUNK), []
                for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    ids = np.array([*encode(text or ""), END_ID], dtype="<u4")
                    for k, (start, length) in enumerate(cut(len(ids), capacity)):
                        rows.append((part, int(seen[length]), i, k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
                        seen[length] += 1
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["part", "nth", "doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "part int, nth long, doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, capacity: int = CAPACITY, ranks_path: str | None = None) -> DataFrame:
    """One row per piece of each row of ``docs(doc_id, text)``: where it lies in which sequence.

    A null text counts as empty: one piece, the end token. Rows with a null or repeated doc_id are packed
    like others. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    each = written(pieces(docs, capacity, ranks_path), "pieces")  # the ranks are those of the tasks that were committed
    by_part = written(each.groupBy("part", "length").agg(F.count("*").alias("n")), "by_part")
    # at most ``capacity`` rows, whatever the corpus
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(places(plan(counts, capacity)))
    before = by_part.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.r_[True, length[order][1:] != length[order][:-1]]) if len(order) else []
            for at in np.split(order, cuts[1:]) if len(order) else []:
                first, base, off = table.value[int(length[at[0]])]
                run = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at] = base[run] + rank[at] - first[run]
                offset[at] = off[run]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    ranked = each.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
