"""op9_classifier against a plain scorer, and the fit against its own likelihood, written out row by row."""

import re
import string
import zlib
from math import exp, log

import numpy as np
import pytest

from corpusloom.llm import classifier as C

SF = "/root/testdata/sf0.001"


def brute_features(text):
    """(slots with repeats, style shares) by regular expressions."""
    t = text or ""
    plain = re.sub("[" + re.escape(string.punctuation) + "\x00-\x1f\x7f]", " ", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    words = [w for w in plain.encode().split(b" ") if w]
    seen = set(words) | {b"^" + w[:4] for w in set(words) if len(w) > 4}
    size, n, raw = max(1, len(t.encode())), max(1, len(words)), t.encode()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    style = [
        sum(raw.count(c.encode()) for c in "#*$%&<>") / size, sum(raw.count(c.encode()) for c in string.ascii_uppercase) / size,
        raw.count(b"!") / n, raw.count(b"|") / n, 1 - len(set(lines)) / max(1, len(lines)), len(set(words)) / n,
    ]
    return [zlib.crc32(w) % 2**18 for w in seen], [min(1.0, x) for x in style]


def brute_grade(model, text):
    slots, style = brute_features(text)
    s = sum(float(model.weights[k]) for k in slots) + sum((x - m) / z * w for x, m, z, w in zip(style, model.mean, model.scale, model.style))
    above = [1 / (1 + exp(min(500, max(-500, t - s)))) for t in model.cuts]
    return sum(above), above[-1]


def test_query_equals_plain_scorer(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = C.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = C.classify(docs, labels).collect()
    assert len(got) == len(texts) and len({r.kept for r in got}) == 2
    for r in got:
        expected, tail = brute_grade(model, texts[r.doc_id])
        assert r.expected_grade == pytest.approx(expected, abs=1e-6) and r.p_tail == pytest.approx(tail, abs=1e-6)
        assert r.kept == (tail >= C.MIN_TAIL) or abs(tail - C.MIN_TAIL) < 1e-6


def test_fit_is_near_the_maximum_of_the_likelihood():
    rng = np.random.default_rng(3)
    n, vocab = 120, 12
    rows = [sorted(set(rng.integers(0, vocab, 5).tolist())) for _ in range(n)]
    truth = rng.normal(size=vocab)
    y = np.digitize([sum(truth[r]) + rng.logistic() for r in rows], [-1.0, 1.0])
    dense = rng.random((n, 2))
    l2 = 0.05
    model = C.fit(y, np.concatenate(rows), np.array([len(r) for r in rows]), dense, l2=l2, steps=2000)

    def loss(w, style, cuts):
        total = 0.0
        for r, x, g in zip(rows, (dense - model.mean) / model.scale, y):
            s = sum(w[k] for k in r) + float(x @ style)
            edge = [0.0, *(1 / (1 + exp(s - t)) for t in cuts), 1.0]
            total -= log(edge[g + 1] - edge[g])
        return total / n + l2 / 2 * (float(w @ w) + float(style @ style))

    w, style, cuts = model.weights[:vocab].astype(float), model.style, model.cuts
    assert list(cuts) == sorted(cuts)
    best = loss(w, style, cuts)
    assert best < loss(np.zeros(vocab), np.zeros(2), cuts) - 0.1
    for part, size in ((0, vocab), (1, 2), (2, len(cuts))):
        for i in range(size):
            at = [w.copy(), style.copy(), np.array(cuts, float)]
            at[part][i] += 1e-4
            up = loss(*at)
            at[part][i] -= 2e-4
            assert abs(up - loss(*at)) / 2e-4 < 5e-3, (part, i)
