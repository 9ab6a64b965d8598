import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from corpusloom.llm import classifier
from corpusloom.llm.packing import cut

from .test_near_copies import brute as near
from .test_rules import brute as counts
from .test_suffix import brute as windows


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(11)
    vocab = ["".join(rnd.choice("aeioubcdfgklmnprst") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    shared = prose(120)
    texts = [prose(rnd.randint(60, 200)) for _ in range(60)]
    texts += [f"{prose(60)}\n{shared}\n{prose(60)}" for _ in range(5)]
    texts += [f"{prose(30)}\n{shared[:260]}\n{prose(60)}", f"{prose(30)}\n{'x' * 300}\n{prose(60)}", f"{prose(40)}\n{'x' * 300}\n{prose(60)}"]  # copies of too few words
    texts += [t + " more" for t in texts[:4]] + texts[4:8]
    texts += [" ".join(w + rnd.choice(["###", "&&&"]) for w in prose(90).split()) for _ in range(25)]
    texts += ["too short", "", None, "again and again " * 60]
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    labels = [(i, int("###" not in (t or "")), 0) for i, t in enumerate(texts) if t]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, {i: t for i, t, *_ in rows}


def long_ones(text, places):
    """The places in runs of at least ``P.PASSAGE_WORDS`` words."""
    out = set()
    for p in sorted(places):
        if p - 1 not in places:
            end = next(q for q in range(p, len(text) + 1) if q not in places)
            if len(text[p:end].split()) >= P.PASSAGE_WORDS:
                out |= set(range(p, end))
    return out


def test_each_stage_equals_brute_force(spark, corpus):
    path, texts = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    stages = dict(P.STAGES)

    got = stages["quality rules"](spark, docs, path)
    assert got.columns == docs.columns
    # too few labels for any cutoff: the base rule alone
    want = {i: t for i, t in texts.items() if (c := counts(t))[0] >= 50 and 100 * c[4] <= 50 * c[0]}
    assert {r.doc_id: r.text for r in got.collect()} == want

    model = classifier.train(got, labels)
    want = {i: t for i, t in want.items() if model.grades(np.array([model.score(t.encode())]))[1][0] >= classifier.MIN_TAIL}
    got = stages["quality classifier"](spark, got, path)
    assert got.columns == docs.columns and {r.doc_id: r.text for r in got.collect()} == want
    assert sum("###" in t for t in want.values()) < 12 and sum("###" not in t for t in want.values()) > 50

    rows = sorted(want.items())
    want = {rows[k][0]: rows[k][1] for k in near(rows)}
    got = stages["SimHash near-dedup"](spark, got, path)
    assert got.columns == docs.columns and {r.doc_id: r.text for r in got.collect()} == want

    gone = windows([(i, t.encode()) for i, t in sorted(want.items())], "first", P.PASSAGE_BYTES)
    gone = {i: long_ones(want[i].encode(), gone[i]) for i in want}
    assert sum(map(bool, gone.values())) == 4
    want = {i: bytes(c for p, c in enumerate(t.encode()) if p not in gone[i]).decode() for i, t in want.items()}
    got = stages["suffix-array dedup"](spark, got, path)
    assert got.columns == docs.columns and {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == {i: (t, len(t)) for i, t in want.items()}

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = []
    for i, x in want.items():
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 2], dtype="<u4")
        pieces += [(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), 1024))]
    rows = stages["best-fit packing"](spark, got, path).collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(pieces)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for v in bins.values():
        ends = [0]
        for o, n in sorted(v):
            assert o == ends[-1]
            ends.append(o + n)
        assert ends[-1] <= 1024
    assert sorted(map(str, rows)) == sorted(map(str, P.run(spark, path).collect()))


def test_empty_documents(spark, corpus, tmp_path):
    path, _ = corpus
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{path}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_repeated_and_null_rows(spark, corpus, tmp_path):
    """Exactly repeated rows leave one row in the packing; null ids and texts, and a clashing column, do no harm."""
    path, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    one = docs.where("doc_id = 3").drop("doc_id").selectExpr("cast(null as long) as doc_id", "reverse(text) as text", "lang", "source", "n_chars")
    more = docs.unionByName(docs).unionByName(one).unionByName(one).withColumn("spans", docs.source)
    more.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{path}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    got = [tuple(r)[:5] for r in P.run(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got))
    # the reversed text has no labelled words in common, so the classifier may drop it; all others are as without repeats
    assert {g for g in got if g[0] is not None} == {tuple(r)[:5] for r in P.run(spark, path).collect()}
