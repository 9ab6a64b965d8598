import random

import numpy as np
import xxhash

from corpusloom.llm import simhash as S


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    """{id: component} for {id: fingerprint}."""
    comp = {i: i for i in fps}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(fps)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    return {i: find(i) for i in ids}


def test_covering_radius_and_reach():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 2**63, 500, dtype=np.uint64)
    i, key, home = S.anchors(fp)
    reach = {}
    for a, k in zip(i, key):
        reach.setdefault(int(a), set()).add(int(k))
    assert max(map(len, reach.values())) <= 34
    for n in range(500):
        for bits in ([], [3], [40], [1, 33], [2, 9, 50], [35, 40, 63]):
            y = fp[n]
            for b in bits:
                y ^= np.uint64(1 << b)
            j, k, h = S.anchors(np.array([y], dtype=np.uint64))
            assert {int(x) for x, z in zip(k, h) if z} & reach[n]


def test_fingerprint_cases():
    for t in (None, "", " \n", "one", "One  two", "a b c", "a b c d e f " * 50, "é Ü x y\x0bz", "A\x00B c D e"):
        assert S.fingerprint(None if t is None else t.encode()) == brute_fingerprint(t)


def test_links_equal_brute_force(spark):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(12)]
    fps = {}
    for n in range(400):
        x = rnd.choice(base)
        for b in rnd.sample(range(64), rnd.randint(0, 7)):
            x ^= 1 << b
        fps[n] = x
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for hot in (10**6, 5):
        first = {}
        for n, x in fps.items():
            first.setdefault(x, n)
        df = spark.createDataFrame([(signed(x), n) for x, n in first.items()], "fp long, rep long")
        got = dict(map(tuple, S.connected_components(S.links(df, hot=hot)).collect()))
        want = brute_components(fps)
        assert {n: got.get(first[x], first[x]) for n, x in fps.items()} == want


def test_near_duplicates_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(1, "", "x"), (2, None, "x"), (3, "a b c d", None), (4, "A b C d", "y"), (4, "A b C d", "y"), (5, long, "z"), (6, long + " tail", "z"), (None, "a b c d", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(map(tuple, S.near_duplicates(df).collect()), key=str)
    fps = {i: brute_fingerprint(t) for i, t, _ in rows if i}
    want = brute_components(fps)
    assert len(got) == len(rows)
    for i, fp, c in got:
        assert (int(fp, 16), c) == ((fps[i], want[i]) if i else (fps[3], want[3]))
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_null_ids_carry_links(spark):
    """A row without an id links two others that are apart from each other."""
    rows = [(5, 0b0), (None, 0b111), (2, 0b111111), (None, -1)]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    distinct = df.select("fp", df.fp.alias("rep"))
    got = {tuple(r) for r in S.links(distinct).collect()}
    assert {frozenset(x) for x in got} == {frozenset((0, 7)), frozenset((7, 63))}
