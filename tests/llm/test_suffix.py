import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from corpusloom.llm import suffix as S

L, G = 24, 6


def brute(rows, keep, length):
    """{row index: removed byte set} from all windows of all documents."""
    seen = defaultdict(list)
    for i, t in rows:
        for p in range(len(t) - length + 1):
            seen[t[p : p + length]].append((i, p))
    gone = defaultdict(set)
    for v in seen.values():
        for i, p in v if keep == "none" and len(v) > 1 else sorted(v)[1:]:
            gone[i] |= set(range(p, p + length))
    return gone


def spans(gone):
    return sum(1 for x in gone if x - 1 not in gone)


def corpus(n, seed):
    rnd = random.Random(seed)
    shared = ["".join(rnd.choice("abcde é") for _ in range(rnd.randint(20, 90))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [rnd.choice(shared)[rnd.randint(0, 6) :] if rnd.random() < 0.6 else "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(5, 60))) for _ in range(rnd.randint(1, 5))]
        rows.append((i, "".join(parts)))
    rows += [(n + i, rows[i][1]) for i in range(6)] + [(n + 10, "x" * 300), (n + 11, "xy" * 100), (n + 12, ""), (n + 13, "short")]
    return rows


def test_previous_factors_give_the_lpf_threshold():
    rnd = random.Random(1)
    for _ in range(30):
        t = bytes(rnd.choice(b"ab") for _ in range(120))
        depth = rnd.choice([1, 3, 5, 7])
        rank = S.suffix_ranks(np.frombuffer(t, np.uint8), depth)
        n = len(t) - depth + 1
        order, _, earlier = S.previous_factors(rank[:n], np.arange(n))
        got = np.zeros(n, bool)
        got[order] = earlier
        assert got.tolist() == [t[i : i + depth] in {t[j : j + depth] for j in range(i)} for i in range(n)]


@pytest.mark.parametrize("keep,hot,segment", [("none", 1000, 1 << 18), ("first", 1000, 1 << 18), ("none", 2, 37), ("first", 2, 37)])
def test_equals_brute_force(spark, monkeypatch, keep, hot, segment):
    monkeypatch.setattr(S, "SEGMENT", segment)
    rows = corpus(60, 4)
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, spans string").repartition(3)
    gone = brute([(i, t.encode()) for i, t in rows], keep, L)
    got = {r.doc_id: r for r in S.removal(df, keep, L, gram=G, hot=hot).collect()}
    assert len(got) == len(rows) and any(gone.values())
    for i, t in rows:
        b = t.encode()
        left = bytes(c for p, c in enumerate(b) if p not in gone[i])
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), len(gone[i]), spans(gone[i]), hashlib.sha256(left).hexdigest())


def test_edge_rows(spark):
    long = " ".join(f"w{i * 7919 % 100003}" for i in range(20000))
    rows = [(1, None, 0), (2, "", 0), (3, long, 9), (4, "other " + long[5000:9000] + " end", 9), (5, "same " * 100, 1), (5, "same " * 100, 1), (None, long[:3000], 2), (6, "é" * 300 + "q", None), (7, "é" * 300 + "r", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    gone = brute([(k, (t or "").encode()) for k, (_, t, _) in enumerate(rows)], "none", 400)
    got = sorted(map(tuple, S.removal(df).select("doc_id", "n_removed", "n_spans").collect()), key=str)
    assert got == sorted([(i, len(gone[k]), spans(gone[k])) for k, (i, _, _) in enumerate(rows)], key=str)
    kept = S.without_copies(df)
    assert kept.columns == df.columns and kept.count() == len(rows)
    by = {r.doc_id: r for r in kept.collect() if r.doc_id not in (5, None)}
    assert by[1].text is None and by[2].text == "" and len(by[4].text) <= 12 and by[4].n_chars == len(by[4].text)
    assert S.removal(df.limit(0)).count() == 0 and S.without_copies(df.limit(0)).count() == 0


def test_repeated_rows_keep_one(spark):
    """Of repeated rows the first stays whole with keep="first"; the others lose all their bytes if they are long enough."""
    rnd = random.Random(9)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    a, b = text(90), text(12)
    rows = [(1, a)] * 3 + [(1, b)] * 2 + [(None, a), (2, None), (2, None), (3, text(80))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = sorted((r.doc_id, r.text) for r in S.without_copies(df, length=L, gram=G).collect() if r.doc_id is not None)
    rest = sorted([(1, ""), (1, ""), (1, b), (1, b), (3, rows[-1][1])] + [(2, None)] * 2, key=str)
    # the null id is the smallest, so its row is the first one of the text
    assert sorted(got, key=str) == sorted(rest + [(1, "")], key=str)
    df = spark.createDataFrame([r for r in rows if r[0] is not None], "doc_id long, text string")
    got = sorted(map(tuple, S.without_copies(df, length=L, gram=G).collect()), key=str)
    assert got == sorted(rest + [(1, a)], key=str)


def test_periodic_texts_have_few_pieces(spark):
    for t in (b"a" * 100_000, b"xyz " * 25_000):
        assert sum(len(p[0]) for p in S.pieces(t)) <= 3
    rows = [(0, "a" * 500), (1, "a" * 90), (2, "abc" * 50), (3, "abc" * 200 + "q"), (4, "zabc" * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for keep in ("none", "first"):
        gone = brute([(i, t.encode()) for i, t in rows], keep, L)
        got = {r.doc_id: (r.n_removed, r.n_spans, r.text) for r in S.removal(df, keep, L, gram=G).collect()}
        assert got == {i: (len(gone[i]), spans(gone[i]), "".join(c for p, c in enumerate(t) if p not in gone[i])) for i, t in rows}


def test_passages_of_too_few_words_stay(spark):
    long, short = "one two three four five six seven", "abcdefghijklmnopqrstuvwxyzabcdefgh"
    rows = [(1, f"{long} | {short} ."), (2, f"# {short} / {long} !")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in S.without_copies(df, length=L, gram=G, min_words=5).collect()}
    assert got[1] == rows[0][1] and got[2].startswith(f"# {short}") and "three" not in got[2]
