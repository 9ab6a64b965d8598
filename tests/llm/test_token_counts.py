import random
from itertools import combinations

from corpusloom.llm import lattice as L
from corpusloom.llm import token_counts as T


def vocab():
    return L.vocabulary(L.default_path())


def segmentations(v, w):
    """All (score, n ids, ids) of a word, by cutting it in every way."""
    best = {}
    for end in range(1, len(w) + 1):
        for start, weight, ids in v.ending(w, end):
            best[start, end] = (weight, ids)
    for n in range(len(w)):
        for cuts in combinations(range(1, len(w)), n):
            edges = [0, *cuts, len(w)]
            if all(p in best for p in zip(edges, edges[1:])):
                parts = [best[p] for p in zip(edges, edges[1:])]
                yield sum(p[0] for p in parts), tuple(i for p in parts for i in p[1])


WORDS = [" the", " there", " therefore", "th", " ", "\n", "é", " é知", "▁", " x▁y", "\U0001f600", "aaaaaaaa", " Tionwhed", "\t", " naïve", "1234", "\x00"]


def test_equals_all_segmentations():
    v = vocab()
    got = T.terminal_counts(v, WORDS)
    for w in WORDS:
        top = max(s for s, _ in segmentations(v, w))
        assert got[w] in {len(i) for s, i in segmentations(v, w) if abs(s - top) < 1e-9}, w


def test_shared_prefix_equals_word_by_word():
    rnd = random.Random(4)
    words = {" " * rnd.randint(0, 1) + "".join(rnd.choice("theraiongé") for _ in range(rnd.randint(1, 14))) for _ in range(3000)}
    got = T.terminal_counts(vocab(), words)
    assert all(got[w] == T.terminal_counts(vocab(), [w])[w] for w in words)


def test_pre_tokens_are_lossless():
    t = "  two  blanks\n\nlines \t tab▁ end "
    assert "".join(L.PRE_TOKEN.findall(t)) == t


def test_rows(spark):
    long = "word " * 60000 + "x" * 3000
    rows = [(1, None, 0), (2, "", 0), (3, "the cat\nsat", 0), (3, "the cat\nsat", 0), (None, "the", 0), (4, long, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, T.token_counts(df).collect()), key=str)
    v = vocab()
    want = []
    for i, t, _ in rows:
        words = L.PRE_TOKEN.findall(t or "")
        n = T.terminal_counts(v, set(words))
        want.append((i, len(words), sum(n[w] for w in words)))
    assert got == sorted(want, key=str)
    assert T.token_counts(df.limit(0)).count() == 0
