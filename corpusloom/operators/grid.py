"""All similar pairs of a table's texts, counted block against block: exact, and only what is similar leaves a task.

Where texts share most of their shingles, an inverted index gives out far more candidates than there are pairs. Here the texts
are dealt into blocks and one task has each pair of blocks. It finds the shingles of both and counts what every two texts of
fitting sizes share: by a matrix product over the frequent shingles, by posting lists over the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import stars

#: Characters of a block; blocks that a small table has at most, and characters from which it has one more.
BLOCK, LEAST_BLOCKS, LEAST_CHARS = 8_000_000, 8, 250_000
#: Texts of a tile's side; a shingle that more than one of so many texts has is frequent; meetings that are added up at a time.
TILE_X, TILE_Y, RARE, MEETINGS = 1024, 4096, 16, 1 << 22
#: Codes that are renumbered through a table rather than by sorting.
TABLE = 1 << 23
#: Rows of a batch that is given out.
BATCH = 1 << 14


def blocks(chars: int) -> int:
    return max(-(-chars // BLOCK), min(LEAST_BLOCKS, -(-chars // LEAST_CHARS)), 1)


def _high(task: int) -> int:
    return (math.isqrt(8 * task + 1) - 1) // 2


def _low(task: int) -> int:
    return task - _high(task) * (_high(task) + 1) // 2


def _renumbered(code: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """``code`` (under ``size``) by numbers without gaps, and how many there are."""
    if size > TABLE:
        kinds, code = np.unique(code, return_inverse=True)
        return code.astype(np.int32), len(kinds)
    seen = np.zeros(size, bool)
    seen[code] = True
    return (np.cumsum(seen, dtype=np.int32) - 1)[code], int(seen.sum())


def shingled(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(text, shingle) of every k characters in a row, repeats included, shingles by number, and how many numbers there are.

    A shorter text is its only shingle.
    """
    length = np.array([len(t) for t in texts], np.int64)
    # k marks that are no character follow each text, so a shorter one has a shingle of its own
    ends = np.cumsum(length + k)
    chars = np.frombuffer("".join(t + "\0" * k for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    char, size = _renumbered(chars, 0x110000)
    char += 1
    for j in range(1, k + 1):
        char[ends - j] = 0
    size += 1
    starts = np.maximum(length - k, 0) + 1
    of = np.repeat(np.arange(len(texts), dtype=np.int32), starts)
    at = np.arange(len(of)) - np.repeat(np.cumsum(starts) - starts, starts) + np.repeat(ends - length - k, starts)
    code, kinds = char[at], size
    for j in range(1, k):
        code, kinds = code.astype(np.int64) * size + char[at + j], kinds * size
        code, kinds = _renumbered(code, kinds)
    return of, code, kinds


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one after the other."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


class Sets:
    """The shingle sets of texts in order of their sizes: a matrix of the frequent shingles and lists of the rare ones."""

    def __init__(self, of: np.ndarray, code: np.ndarray, often: np.ndarray, texts: int):
        common = often[code]
        dense = np.zeros((texts, int(often.sum())), bool)
        dense[of[common], (np.cumsum(often) - 1)[code[common]]] = True
        rare = np.unique(of[~common].astype(np.int64) * len(often) + code[~common])
        row = rare // len(often)
        n = dense.sum(1) + np.bincount(row, minlength=texts)
        self.order = np.argsort(n, kind="stable")
        self.n, self.dense = n[self.order], dense[self.order]
        place = np.empty(texts, np.int64)
        place[self.order] = np.arange(texts)
        self.row, self.code = place[row], rare % len(often)

    def tiles(self, size: int) -> list[tuple[int, int]]:
        return [(at, min(at + size, len(self.n))) for at in range(0, len(self.n), size)]

    def frequent(self, lo: int, hi: int) -> np.ndarray:
        return self.dense[lo:hi].astype(np.float32)

    def rare(self, lo: int, hi: int, by_code: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(row from ``lo`` on, shingle) of the rows ``lo`` to ``hi``, in order of rows or shingles."""
        take = np.flatnonzero((self.row >= lo) & (self.row < hi))
        row, code = self.row[take] - lo, self.code[take]
        order = np.argsort(code if by_code else row, kind="stable")
        return row[order], code[order]


def _add_rare(both: np.ndarray, x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> None:
    """Count in ``both`` the rare shingles of ``x``, by row, that are also in ``y``, by shingle."""
    row, code = x
    first = np.searchsorted(y[1], code)
    size = np.searchsorted(y[1], code, "right") - first
    row, first, size = row[size > 0], first[size > 0], size[size > 0]
    wide, total, at = both.shape[1], np.cumsum(size), 0
    flat = both.reshape(-1)
    while at < len(size):
        to = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + MEETINGS, "right")), at + 1)
        low = int(row[at]) * wide
        sums = np.bincount(np.repeat(row[at:to] * wide - low, size[at:to]) + y[0][_ranges(first[at:to], size[at:to])])
        flat[low : low + len(sums)] += sums
        at = to


def alike(x: Sets, y: Sets, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, shared, in either) for texts a of ``x`` and b of ``y`` whose similarity can reach ``least``; each pair once if both are one."""
    least = max(least, 0.0)
    for y0, y1 in y.tiles(TILE_Y):
        frequent, rare = y.frequent(y0, y1).T, y.rare(y0, y1, by_code=True)
        for x0, x1 in x.tiles(TILE_X):
            if x.n[x1 - 1] < least * y.n[y0] - 1e-9 or y.n[y1 - 1] < least * x.n[x0] - 1e-9 or (x is y and x0 >= y1):
                continue
            both = x.frequent(x0, x1) @ frequent
            _add_rare(both, x.rare(x0, x1), rare)
            n = (x.n[x0:x1, None] + y.n[None, y0:y1]).astype(np.float32)
            hit = both * np.float32(1 + least) >= n * np.float32(least) - np.float32(1e-6) * n - np.float32(1e-3)
            if x is y:
                hit &= np.arange(x0, x1)[:, None] < np.arange(y0, y1)[None, :]
            i, j = np.nonzero(hit)
            shared = both[i, j].astype(np.int64)
            yield x.order[x0 + i], y.order[y0 + j], shared, x.n[x0 + i] + y.n[y0 + j] - shared


def _title_similarity(a: list[str], b: list[str], k: int) -> np.ndarray:
    """Jaccard similarity of the shingle sets of titles a and b, pair by pair; each different pair is compared once."""
    sets = {t: {t[i : i + k] for i in range(len(t) - k + 1)} if len(t) >= k else {t} for t in {*a, *b}}
    seen: dict[tuple[str, str], float] = {}
    for t, u in set(zip(a, b)):
        shared = len(sets[t] & sets[u])
        seen[t, u] = shared / (len(sets[t]) + len(sets[u]) - shared)
    return np.array([seen[p] for p in zip(a, b)], np.float64)


def similar(reps: DataFrame, n: int, k: int, threshold: float, weights: tuple[float, float], spanning: bool = False) -> DataFrame:
    """(a, b, sim) for all pairs of ``reps(pos, title, content)`` with a similarity of at least ``threshold``, in ``n`` blocks.

    ``weights`` are the title's and the content's. With ``spanning`` each task gives out only pairs (a, b, null) that connect what
    its pairs connect.
    """
    least = (threshold - weights[0]) / weights[1]

    def task(rows: list[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        block, pos = (np.concatenate([b.column(c).to_numpy() for b in rows]) for c in (1, 2))
        title, content = ([t for b in rows for t in b.column(c).to_pylist()] for c in (3, 4))
        order = np.argsort(block, kind="stable")
        block, pos = block[order], pos[order]
        title = np.array([title[i] for i in order], object)
        of, code, kinds = shingled([content[i] for i in order], k)
        content.clear()
        often = np.bincount(code, minlength=kinds) * RARE > len(pos)
        mid = int(np.searchsorted(block, block[-1]))
        if mid:
            first = int(np.searchsorted(of, mid))
            sides = Sets(of[:first], code[:first], often, mid), Sets(of[first:] - mid, code[first:], often, len(pos) - mid)
        else:
            sides = (one := Sets(of, code, often, len(pos)), one)
        del of, code
        for i, j, shared, either in alike(*sides, least):
            j = j + mid
            sim = weights[0] * _title_similarity(title[i].tolist(), title[j].tolist(), k) + weights[1] * (shared / either)
            keep = sim >= threshold
            a, b = pos[i[keep]], pos[j[keep]]
            yield np.minimum(a, b), np.maximum(a, b), sim[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "sim"]
        held: dict[int, list[pa.RecordBatch]] = {}
        for b in batches:
            where = b.column(0).to_numpy()
            for t in np.unique(where).tolist():
                held.setdefault(t, []).append(b.filter(pa.array(where == t)))
        for t in sorted(held):
            rows, star = held.pop(t), (np.zeros(0, np.int64), np.zeros(0, np.int64))
            # a task of two blocks has nothing to compare if one is empty; the other one has a task of its own
            if _low(t) != _high(t) and len({x for b in rows for x in np.unique(b.column(1).to_numpy()).tolist()}) < 2:
                continue
            for a, b, sim in task(rows):
                if spanning:
                    star = stars(np.concatenate([star[0], a]), np.concatenate([star[1], b]))
                    continue
                for at in range(0, len(a), BATCH):
                    yield pa.RecordBatch.from_arrays([pa.array(v[at : at + BATCH]) for v in (a, b, sim)], names=names)
            for at in range(0, len(star[0]), BATCH):
                a, b = (v[at : at + BATCH] for v in star)
                yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(a), pa.nulls(len(a), pa.float64())], names=names)

    own = F.pmod(F.xxhash64("pos"), F.lit(n)).cast("int")
    low, high = "least(block, other)", "greatest(block, other)"
    dealt = (
        reps.select(F.col("pos").cast("long").alias("pos"), "title", "content", own.alias("block"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .select(F.expr(f"cast({high} * ({high} + 1) / 2 as int) + {low}").alias("task"), "block", "pos", "title", "content")
    )
    return dealt.repartitionById(n * (n + 1) // 2, "task").mapInArrow(run, "a long, b long, sim double")
