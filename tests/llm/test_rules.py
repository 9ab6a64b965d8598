import re
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import rules as R


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(wins)
    covered = {j for i, w in enumerate(wins) if n[w] > 1 for j in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", "  \n\t", "a b", "a b c a b c", "x\ny\nx\n \n\nx y z x y z x y", "é# <b>\x0b知识 & | % $\r\n" * 40, "word " * 5000, "\x1f x　y " * 30,
         " ".join(f"w{i % 97}" for i in range(20000)), "one two three four\n" * 3 + "five six"]


def test_counts_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, "en", 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, n_words int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in R.judge(df, labels).collect()}
    for i, t in enumerate(TEXTS):
        want = brute(t)
        assert tuple(got[i][c] for c in R.COUNTS[:5]) == want, (i, want)
        assert got[i].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert got[i].kept == (not got[i].base_failed)
    assert R.judge(df.limit(0), labels).count() == 0


@pytest.mark.parametrize("n,k,p", [(10, 0, 0.01), (500, 2, 0.01), (3000, 20, 0.01), (900, 0, 0.02), (100, 1, 0.5)])
def test_binomial_tail(spark, n, k, p):
    want = sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
    got = spark.range(1).select(R.binomial_tail(F.lit(n), F.lit(k), p)).first()[0]
    assert got == pytest.approx(want, rel=1e-9)


def test_cutoffs_control_the_risk(spark):
    clean, junk = " ".join(f"word{i}" for i in range(80)), " ".join(f"word{i}###" for i in range(80))
    rows = [(i, junk if i % 5 == 0 else clean, "en") for i in range(6000)] + [(9000 + i, clean, None) for i in range(20)] + [(None, junk, "en"), (9999, junk, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(6000)], "doc_id long, quality int, toxic int")
    got = R.judge(docs, labels).collect()
    for r in got:
        bad = r.n_symbols > 0
        assert r.kept == (not bad or r.doc_id == 9999)  # too few labels in stratum xx: only the base rule there
    kept = R.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_rule_that_hits_good_documents_rests(spark):
    rows = [(i, " ".join(f"w{j}{'#' * (i % 2)}" for j in range(60)), "en") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(4000)], "doc_id long, quality int, toxic int")
    assert R.judge(docs, labels).where("kept").count() == 4000
