from collections import Counter
from math import exp

import numpy as np
import pytest

from corpusloom.llm import lattice as L
from corpusloom.llm import sampling as S

PATH = L.default_path()


def vocab():
    return L.vocabulary(PATH)


def draw(text, k, times, seed=0):
    """For each of ``times`` keys: [(ids, log probability, perturbed)], threshold."""
    lat, got = S.segment([text] * times, np.arange(times, dtype=np.uint64) + np.uint64(seed << 32), k, PATH)
    raw = np.array(vocab().byte_ids)
    return [([(tuple(S.ids_of(lat, e, w, raw).tolist()), lp, v) for e, w, lp, v in samples], least) for samples, least in got]


def all_segmentations(text):
    """{ids: probability} by enumerating every cut of every pre-token."""
    v, total = vocab(), {(): 0.0}
    for w in L.PRE_TOKEN.findall(text):
        ways = [[((), 0.0)]]
        for end in range(1, len(w) + 1):
            ways.append([(ids + e, s + weight) for start, weight, e in v.ending(w, end) for ids, s in ways[start]])
        norm = sum(exp(s) for _, s in ways[-1])
        total = {a + ids: p + s - np.log(norm) for a, p in total.items() for ids, s in ways[-1]}
    return {k: exp(p) for k, p in total.items()}


@pytest.mark.parametrize("text", [" the cat\nx", "é知 ab▁\U0001f600", "aaaa  b"])
def test_probabilities_of_paths(text):
    truth = all_segmentations(text)
    assert sum(truth.values()) == pytest.approx(1)
    for samples, _ in draw(text, 30, 5):
        for ids, lp, _ in samples:
            assert exp(lp) == pytest.approx(truth[ids])


def test_exhausts_without_replacement_in_order():
    truth = all_segmentations(" the")
    for samples, least in draw(" the", 1000, 20):
        ids = [x for x, _, _ in samples]
        assert len(ids) == len(set(ids)) == len(truth) and least == float("-inf")
        values = [v for _, _, v in samples]
        assert values == sorted(values, reverse=True)


def test_distribution_without_replacement():
    """First and second draws against the exact sequential distribution p_i and p_i p_j / (1 - p_i)."""
    truth, n = all_segmentations(" the"), 20000
    first, pair = Counter(), Counter()
    for samples, least in draw(" the", 2, n, 3):
        (a, _, x), (b, _, y) = samples
        assert x >= y >= least
        first[a] += 1
        pair[a, b] += 1
    for a, p in truth.items():
        assert first[a] / n == pytest.approx(p, abs=0.015)
        for b, q in truth.items():
            if a != b:
                assert pair[a, b] / n == pytest.approx(p * q / (1 - p), abs=0.015)


def test_inclusion_scores_estimate_one():
    """Weights p / inclusion of the samples sum to 1 on average (Horvitz-Thompson)."""
    total = [sum(exp(lp) / -np.expm1(-np.exp(lp - least)) for _, lp, _ in samples) for samples, least in draw(" the cat", 3, 6000, 4)]
    assert np.mean(total) == pytest.approx(1, abs=0.05)


def test_rows(spark):
    long = "The quick brown fox\n" * 3000
    rows = [(1, None, "z"), (2, "", "z"), (3, "x", "z"), (4, " the cat", "z"), (4, " the cat", "z"), (None, "é知\U0001f600▁ <s>\x00", "z"), (5, long, "z"), (6, "q" * 5000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sample string").repartition(3)
    got = S.sampled_ids(df, k=3).collect()
    texts = {i: t or "" for i, t, _ in rows}
    by = Counter(r.doc_id for r in got)
    assert by == {1: 1, 2: 1, 3: 1, 4: 6, None: by[None], 5: 3, 6: 3}
    for r in got:
        assert r.round_trip and S.decode(r.ids, vocab()) == texts[r.doc_id] and r.n_tokens == len(r.ids)
        assert r.log_inclusion <= 1e-9
    for i in (4, 5, 6):
        assert len({tuple(r.ids) for r in got if r.doc_id == i}) == 3
    again = S.sampled_ids(df.repartition(1), k=3).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert S.sampled_ids(df.limit(0)).count() == 0


def test_lattice_has_each_prefix_once():
    """Words that begin alike share their places, so a vocabulary of similar words is a fraction of its characters."""
    rnd = np.random.default_rng(5)
    words = list(dict.fromkeys("".join(rnd.choice(list("ab é\U0001f600"), rnd.integers(1, 12))) for _ in range(400)))
    chars, depth, up, ends = S.prefixes(words)
    spelled = {}
    for i in range(len(chars)):
        spelled[i] = (spelled[int(up[i])] if up[i] >= 0 else "") + chr(int(chars[i]))
        assert len(spelled[i]) == depth[i] and up[i] < i
    assert [spelled[int(e)] for e in ends] == words
    assert sorted(spelled.values()) == sorted({w[:n] for w in words for n in range(1, len(w) + 1)})
    lat = S.Lattice(words, S.trie(PATH))
    assert len(lat.ptr) - 1 == len(chars) < sum(map(len, words)) and len(S.prefixes([])[0]) == 0
