import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import classifier as C

SF = "/root/testdata/sf0.1"


def test_gradient_of_the_likelihood_leads_to_ordered_thresholds_and_signs():
    rng = np.random.default_rng(0)
    n = 900
    x = rng.integers(0, 2, n)  # slot 7 present or not
    z = 2.5 * x + rng.logistic(size=n)
    grade = np.digitize(z, [0.0, 2.0])
    idx = np.concatenate([np.array([7, 9] if v else [9], np.int32) for v in x])
    m = C.fit(grade, idx, np.where(x, 2, 1), np.zeros((n, 6)), l2=1e-6, steps=800)
    assert m.cuts[0] < m.cuts[1]
    assert m.weights[7] == pytest.approx(2.5, abs=0.5)
    # expected shares of the grades equal the observed ones at the optimum
    base = np.where(x, m.weights[7], 0) + m.weights[9]
    expected, tail = m.grades(base)
    assert tail.mean() == pytest.approx((grade == 2).mean(), abs=0.02)
    assert expected.mean() == pytest.approx(grade.mean(), abs=0.03)
    assert (expected >= 2 * tail - 1e-9).all() and (expected <= 1 + tail + 1e-9).all()


def test_edge_rows(spark):
    good, bad = "clean words and nothing else here", "awful### junk&&& text$$$ again%%%"
    rows = [(i, bad if i % 3 == 0 else good, "s", 1.0) for i in range(60)] + [(100, None, "s", 1.0), (101, "", "s", 1.0), (None, bad, "s", 1.0), (5, good, "s", 1.0), (102, "good " * 200_000, "s", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, p_tail double")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 6 == 0)) for i in range(60)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = C.classify(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None or r.doc_id < 60 and r.doc_id % 3 == 0:
            assert r.p_tail < 0.5 and not r.kept
        elif r.doc_id < 60:
            assert r.p_tail > 0.5
    kept = C.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    none = C.classify(docs, labels.where("quality = 1 and toxic = 0")).collect()
    assert all(r.kept and r.p_tail is None for r in none)
    assert C.classify(docs.limit(0), labels).count() == 0
    assert C.classify(docs, labels.limit(0)).where("kept").count() == len(rows)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.pmod(F.xxhash64(F.col("doc_id") + 7), F.lit(4)) == 0
    model = C.train(docs, labels.where(~held))
    rows = docs.join(labels.where(held), "doc_id").select("text", (F.col("quality") - F.col("toxic") == 1).alias("good")).collect()
    tail = model.grades(np.array([model.score(r.text.encode()) for r in rows]))[1]
    right = np.mean([(p >= 0.5) == r.good for p, r in zip(tail, rows)])
    assert len(rows) > 600 and right >= 0.9
