"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= j | x) = sigmoid(t_j - w.x) with one weight vector w shared by all grades and ordered thresholds
t_0 < t_1 < ... The features are the hashed distinct lower-cased words of the whole text, the starts of the
longer ones, and a few style shares. The model is fitted on a bounded sample of the labelled rows (``SAMPLE``, a documented parameter, drawn by
hash); every document is scored. The grade is quality + (not toxic): 0, 1 or 2. A document is kept
if the tail probability P(grade = 2) is at least ``MIN_TAIL``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most labelled rows that the fit reads, the most distinct words of one of them that it takes (by hash).
SAMPLE, SAMPLE_WORDS = 20_000, 4000
BITS, MIN_DOCS, L2, STEPS = 18, 3, 1e-4, 250
MIN_TAIL = 0.9
#: Lower-cases A-Z and turns ASCII punctuation into spaces.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
STYLE = ("symbols", "capitals", "exclaims", "pipes", "dup_lines", "distinct")


def slot(word: bytes) -> int:
    return zlib.crc32(word) & (1 << BITS) - 1


def parts(text: bytes | None) -> tuple[set[bytes], list[float]]:
    """Distinct lower-cased words of a whole text and the starts of the longer ones, and its style shares in 0..1."""
    text = text or b""
    words = text.translate(PLAIN).split()
    seen = set(words)
    distinct = len(seen)
    seen |= {b"^" + w[:4] for w in seen if len(w) > 4}
    n, chars = max(len(words), 1), max(len(text), 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = lambda drop: (len(text) - len(text.translate(None, drop))) / chars
    style = [share(b"#*$%&<>"), share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), text.count(b"!") / n, text.count(b"|") / n, 1 - len(set(lines)) / max(len(lines), 1), distinct / n]
    return seen, [min(1.0, x) for x in style]


class Model:
    """Weights by slot, style weights on standardised shares, thresholds (one less than there are grades)."""

    def __init__(self, weights: np.ndarray, style: np.ndarray, mean: np.ndarray, scale: np.ndarray, cuts: np.ndarray):
        self.weights, self.style, self.mean, self.scale, self.cuts = weights, style, mean, scale, cuts
        self.cache: dict[bytes, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def score(self, text: bytes | None) -> float:
        seen, style = parts(text)
        cache, total = self.cache, 0.0
        if len(cache) > 500_000:
            cache.clear()
        for w in sorted(seen):  # a fixed order of summing
            x = cache.get(w)
            if x is None:
                x = cache[w] = float(self.weights[slot(w)])
            total += x
        return total + float(((np.array(style) - self.mean) / self.scale) @ self.style)

    def grades(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and probability of the highest grade."""
        above = 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -500, 500)))
        return above.sum(1), above[:, -1]


def fit(grade: np.ndarray, idx: np.ndarray, sizes: np.ndarray, dense: np.ndarray, l2: float = L2, steps: int = STEPS) -> Model | None:
    """Maximum penalised likelihood by Adam with a decaying step; None if there are fewer than two grades.

    ``idx`` holds the slots of all rows one after the other, ``sizes`` how many each row has, ``dense`` the style shares.
    """
    grades = np.unique(grade)
    if len(grades) < 2:
        return None
    y = np.searchsorted(grades, grade)
    top, n = len(grades) - 1, len(grade)
    row = np.repeat(np.arange(n, dtype=np.int32), sizes)
    used = np.flatnonzero(np.bincount(idx, minlength=1 << BITS) >= MIN_DOCS)
    column = np.full(1 << BITS, -1, np.int32)
    column[used] = np.arange(len(used))
    ok = column[idx] >= 0
    idx, row = column[idx[ok]], row[ok]
    mean, scale = dense.mean(0), dense.std(0) + 1e-3
    dense = (dense - mean) / scale
    d, k = len(used), dense.shape[1]
    share = np.cumsum(np.bincount(y, minlength=top + 1)[:-1]) / n
    cuts = np.log(share / (1 - share))
    theta = np.concatenate([np.zeros(d + k), [cuts[0]], np.log(np.maximum(np.diff(cuts), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    each = np.arange(n)
    for step in range(1, steps + 1):
        gaps = np.exp(theta[d + k + 1 :])
        t = theta[d + k] + np.concatenate([[0.0], np.cumsum(gaps)])
        s = np.bincount(row, theta[:d][idx], n) + dense @ theta[d : d + k]
        cdf = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(np.clip(s[:, None] - t, -500, 500))), np.ones((n, 1))], axis=1)
        slope = cdf * (1 - cdf)
        p = np.maximum(cdf[each, y + 1] - cdf[each, y], 1e-12)
        ds = (slope[each, y + 1] - slope[each, y]) / p  # of the negative log likelihood
        dt = np.zeros((n, top + 2))
        dt[each, y + 1] -= slope[each, y + 1] / p
        dt[each, y] += slope[each, y] / p
        dt = dt[:, 1:-1].sum(0)
        tail = np.cumsum(dt[::-1])[::-1]
        g = np.concatenate([np.bincount(idx, ds[row], d), dense.T @ ds, tail[:1], tail[1:] * gaps]) / n
        g[: d + k] += l2 * theta[: d + k]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.1 * min(1.0, 2 * (1 - step / (steps + 1))) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = theta[:d]
    t = theta[d + k] + np.concatenate([[0.0], np.cumsum(np.exp(theta[d + k + 1 :]))])
    return Model(weights, theta[d : d + k], mean, scale, t)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from at most ``sample`` labelled documents; a document with several labels has its lowest grade."""
    graded = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_id"))
    graded = graded.agg(F.min(F.col("quality") + 1 - F.coalesce("toxic", F.lit(0))).cast("int").alias("_grade"))
    taken = graded.orderBy(F.xxhash64("_id"), "_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [parts(x) for x in b.column(2).cast(pa.binary()).to_pylist()]
            slots = [sorted({slot(w) for w in seen}, key=lambda s: (s * 2654435761 & 0xFFFFFFFF, s))[:SAMPLE_WORDS] for seen, _ in got]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(slots, pa.list_(pa.int32())), pa.array([s for _, s in got], pa.list_(pa.float64()))], names=["id", "grade", "slots", "style"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(taken), F.col("doc_id") == F.col("_id"))
    # repeated rows of a document count once
    rows = rows.groupBy("doc_id").agg(F.min("_grade").alias("_grade"), F.min("text").alias("text"))
    rows = rows.mapInArrow(run, "id long, grade int, slots array<int>, style array<double>")
    got = rows.toArrow().sort_by("id").combine_chunks()
    if not got.num_rows:
        return None
    slots, style = (got.column(i).combine_chunks() for i in (2, 3))
    return fit(got.column(1).to_numpy(), slots.flatten().to_numpy(), slots.value_lengths().to_numpy(), style.flatten().to_numpy().reshape(-1, len(STYLE)))


def _score(rows: DataFrame, model: Model | None, min_tail: float) -> DataFrame:
    """Append expected_grade, p_tail and kept to rows whose last column is the text (as _text)."""
    keep = rows.drop("_text")
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if shared.value is None:
                grade = tail = pa.nulls(b.num_rows, pa.float64())
                kept = pa.array([True] * b.num_rows, pa.bool_())
            else:
                score = np.array([shared.value.score(x) for x in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()])
                grade, tail = shared.value.grades(score) if len(score) else (score, score)
                grade, tail, kept = pa.array(grade), pa.array(tail), pa.array(tail >= min_tail)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], grade, tail, kept], names=[*b.schema.names[:-1], "expected_grade", "p_tail", "kept"])

    schema = keep.schema.add("expected_grade", "double").add("p_tail", "double").add("kept", "boolean")
    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, min_tail: float = MIN_TAIL) -> DataFrame:
    """doc_id, expected_grade (0 to the number of grades less one), p_tail and kept for each row of ``docs(doc_id, text)``.

    ``labels(doc_id, quality, toxic)``. A null text counts as empty. Rows with a null or repeated doc_id are scored like
    others; other columns are ignored. If the labelled documents have fewer than two grades nothing can be
    learned: scores are null and all are kept.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"))
    return _score(rows, train(docs, labels, sample), min_tail)


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, min_tail: float = MIN_TAIL) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with their columns; texts are not shuffled."""
    rows = docs.select(F.struct("*").alias("_row"), F.col("text").cast("string").alias("_text"))
    return _score(rows, train(docs, labels, sample), min_tail).where("kept").select("_row.*")
