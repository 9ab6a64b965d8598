import random

import numpy as np

import corpus_pipeline as P
from corpusloom.llm import near_copies as N
from corpusloom.llm import simhash as S


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def brute(rows):
    """Positions of the rows that stay, for rows whose doc_ids are in rising order."""
    sets, comp = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if comp[i] != comp[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((comp[i], comp[j]))
                comp = [a if c == b else c for c in comp]
    return sorted(set(comp))


def edited(rnd, text, n):
    w = text.split()
    for i in rnd.sample(range(len(w)), n):
        w[i] = f"x{rnd.random():.6f}"
    return " ".join(w)


def corpus():
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    prose = lambda n: " ".join(rnd.choices(vocab, k=n))
    texts = [prose(rnd.randint(60, 250)) for _ in range(40)]
    line = prose(30)
    texts += [f"{prose(60)} {line}" for _ in range(20)]
    texts += [edited(rnd, texts[i], n) for i in range(40) for n in (1, 2, 4)]
    texts += [edited(rnd, texts[0], rnd.randint(0, 5)) for _ in range(60)]
    return list(enumerate(texts))


def test_stage_leaves_no_pair_of_similarity_0_8(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in dict(P.STAGES)["SimHash near-dedup"](spark, docs, "").collect())
    want = brute(rows)
    assert got == want and len(want) < len(rows) - 60


def test_keys_and_similarity(spark):
    t = b"a b c d e f g a b c d e"
    assert len(N.shingle_set(N.words(t))) == len(shingles(t.decode())) and len(N.shingle_set(N.words(b"A b"))) == 1
    assert len(N.shingle_set([])) == 0 and len(N.band_keys(np.zeros(0, np.uint64))) == 0
    rnd = random.Random(2)
    missed = 0
    for _ in range(200):
        a = " ".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=180))
        b = edited(rnd, a, 3)
        s, u = shingles(a), shingles(b)
        x, y = (N.shingle_set(N.words(z.encode())) for z in (a, b))
        assert len(np.intersect1d(x, y)) == len(s & u) and len(x) == len(s)
        missed += not set(N.band_keys(x)) & set(N.band_keys(y))
    assert missed == 0


def test_rows_are_told_apart(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, a), (2, a), (2, b), (None, a), (None, b.upper()), (None, "only here"), (None, "only here"), (3, None), (4, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, N.keep_one(docs).collect()), key=str)
    assert got == sorted([(1, a), (2, b), (None, "only here"), (3, None)], key=str)
    assert N.keep_one(docs.limit(0)).count() == 0
    got = sorted(map(tuple, S.keep_one(docs).collect()), key=str)
    assert got == sorted([(1, a), (2, b), (None, "only here"), (3, None)], key=str)
    assert S.keep_one(docs.limit(0)).count() == 0


def test_anchors_alone_do_not_reach_the_similarity(spark):
    """Pairs of 0.8 and more differ by more than three bits: what the bands are for."""
    rows = corpus()
    fps = [N.set_fingerprint(N.shingle_set(N.words(t.encode()))) for _, t in rows]
    sets = [shingles(t) for _, t in rows]
    near = [(fps[i] ^ fps[j]).bit_count() for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert min(near) <= 3 < max(near)


def test_prefix_pairs_hold_every_similar_pair_and_few_others(spark):
    """60 texts around one hub, similar to it but not to each other, random prose and sets of one to three shingles."""
    rnd = random.Random(11)
    hub = [rnd.getrandbits(64) - 2**63 for _ in range(200)]
    fresh = lambda n: [rnd.getrandbits(64) - 2**63 for _ in range(n)]
    sets = [hub] + [sorted(rnd.sample(hub, 160)) + fresh(rnd.choice([0, 35])) for _ in range(60)]
    sets += [fresh(50) for _ in range(20)] + [rnd.sample(hub, n) for n in (1, 1, 2, 3)]
    sets += [s[: round(len(s) * 0.9)] for s in sets[1:30]]
    comp = [i % 7 if i < 20 else i for i in range(len(sets))]
    alike = lambda x, y: len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y))
    every = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if comp[i] != comp[j]]
    want = {(i, j) for i, j in every if alike(sets[i], sets[j])}
    nodes = spark.createDataFrame([(i, len(s), comp[i]) for i, s in enumerate(sets)], "node long, n long, c long")
    bits = [N.bitmap(np.array(s, np.int64).view(np.uint64)).tolist() for s in sets]
    each = spark.createDataFrame([(i, *x) for i, x in enumerate(zip(sets, bits))], "node long, set array<long>, bits array<long>")
    got = {tuple(r) for r in N._prefix_pairs(nodes, each, 0.8).distinct().collect()}
    assert want and want <= got <= set(every) and len(got) < 2 * len(want), (len(want), len(got), len(every))
