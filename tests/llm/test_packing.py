import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import packing as K
from corpusloom.llm.tokens import default_ranks_path, encoder


def optimum(items, capacity):
    """Fewest bins, by search over all packings."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for r in {b for b in bins if b >= items[i]}:
            rest = list(bins)
            rest.remove(r)
            go(i + 1, [*rest, r - items[i]])
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best[0]


def spread(counts):
    return [k for k, v in counts.items() for _ in range(v)]


def check(plan, counts, capacity):
    got = defaultdict(int)
    for pattern, n in plan:
        assert n > 0 and sum(pattern) <= capacity
        for x in pattern:
            got[x] += n
    assert dict(got) == {k: v for k, v in counts.items() if v}


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(0, 3), max_size=4), st.integers(20, 24))
def test_reduction_keeps_the_optimum(counts, capacity):
    fixed, left = K.reduce_instance(counts, capacity)
    check(fixed + [((x,), 1) for x in spread(left)], counts, capacity)
    assert sum(n for _, n in fixed) + optimum(spread(left), capacity) == optimum(spread(counts), capacity)
    check(K.plan(counts, capacity), counts, capacity)


def plain_best_fit(items, capacity):
    bins = []
    for x in sorted(items, reverse=True):
        fit = [b for b in bins if b >= x]
        if fit:
            bins.remove(min(fit))
            bins.append(min(fit) - x)
        else:
            bins.append(capacity - x)
    return len(bins)


def test_best_fit_with_counts_equals_piece_by_piece():
    rnd = random.Random(5)
    for _ in range(60):
        counts = {rnd.randint(1, 100): rnd.randint(1, 30) for _ in range(rnd.randint(1, 25))}
        got = K.best_fit(counts, 100)
        check(got, counts, 100)
        assert sum(n for _, n in got) == plain_best_fit(spread(counts), 100)


def test_large_histogram_has_a_small_plan():
    rnd = random.Random(7)
    counts = {x: rnd.randint(1, 10**7) for x in range(1, 1025)}
    got = K.plan(counts)
    check(got, counts, 1024)
    assert sum(len(p) for p, _ in got) < 60_000
    total = sum(k * v for k, v in counts.items())
    assert sum(n for _, n in got) <= 1.01 * -(-total // 1024)


def test_cut():
    assert K.cut(1, 4) == [(0, 1)] and K.cut(4, 4) == [(0, 4)] and K.cut(8, 4) == [(0, 4), (4, 4)]
    assert K.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_same_ids_as_tokenizers():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = ["", " ", "Hello  world\n\n x\t", "a" * 3000, "é ü 知识 \U0001f600 <|endoftext|> it's", "1234 ½ ٣ _x_ \x00 ​", "The quick###&&& fox\r\n"]
    for x in texts:
        assert encoder(default_ranks_path()).encode_ordinary(x) == t.encode(x, add_special_tokens=False).ids


def test_pack_whole_rows(spark):
    rnd = random.Random(2)
    long = " ".join(rnd.choice(["the", "of", "xyzzy", "né"]) for _ in range(9000))
    rows = [(1, None, 0), (2, "", 0), (3, long, 0), (3, long, 0), (None, "null id", 0)] + [(i, " ".join(["word"] * rnd.randint(1, 1500)), 1) for i in range(10, 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int").repartition(5)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = K.pack(df).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for v in bins.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 1024
    want = []
    for i, text, _ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want += [(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(K.cut(len(ids), 1024))]
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)
    assert len(bins) <= plain_best_fit([w[3] for w in want], 1024)
    assert K.pack(df.limit(0)).count() == 0
