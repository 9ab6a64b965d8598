import random

import pytest

from corpusloom.llm import urls as U


@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        ("https://WWW.Example.com/en/1?x", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://blog.example.com/en/5#t", "blog.example.com", "/en/5", "example.com/en/", "block"),
        ("http://example.com/EN/5", "example.com", "/EN/5", "com/", "allow"),
        ("http://myexample.com/en/5", "myexample.com", "/en/5", "com/", "allow"),
        ("http://x.net/es/", "x.net", "/es/", "net/es/", "block"),
        ("http://x.net/es", "x.net", "/es", None, "allow"),
        ("ftp://net/fr/a/b", "net", "/fr/a/b", "net/fr/", "block"),
        ("http://example.com", "example.com", "", None, "allow"),
        ("http://example.com?a=/en/", "example.com", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("://", "", "", None, "allow"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ],
)
def test_fixed_rules(url, host, path, rule, verdict):
    assert U.Filter([]).judge(url)[:4] == (host, path, rule, verdict)


def rows(n=1500):
    rnd = random.Random(8)
    for i in range(n):
        spam, lang, key = rnd.random() < 0.2, rnd.choice(["en", "de"]), rnd.choice(["", "?ref=x"])
        host = rnd.choice(["cheap-pills.example.org", "spam.example.org"]) if spam else rnd.choice(["news.example.org", "blog.site.org"])
        bad = rnd.random() < (0.9 if spam and lang == "en" else 0.05)
        yield f"https://{host}/{lang}/{i}{key}", bad


def test_mined_rules_equal_brute_force_counts(spark):
    data = list(rows())
    df = spark.createDataFrame([*data, (None, True), ("http://x.org/1", None)], "url string, bad boolean")
    rules = U.mine(df, min_support=0.01, min_confidence=0.6)
    assert rules and all(r["confidence"] >= 0.6 for r in rules)
    sets = [(set(U.tokens(u)), b) for u, b in data]
    for r in rules:
        hit = [b for t, b in sets if set(r["tokens"]) <= t]
        assert r["confidence"] == pytest.approx(sum(hit) / len(hit)) and sum(hit) >= 0.01 * len(data)
        assert r["index"] in r["tokens"]
        assert not any(set(o["tokens"]) < set(r["tokens"]) and o["confidence"] >= r["confidence"] for o in rules)
    # a URL is blocked just if a rule's tokens are all there, found by looking at every rule
    got = {r.page_id: r for r in U.judge(spark.createDataFrame([(i, u, "x") for i, (u, _) in enumerate(data)], "page_id long, url string, host string"), rules, ()).collect()}
    for i, (u, _) in enumerate(data):
        hits = [r for r in rules if set(r["tokens"]) <= set(U.tokens(u))]
        assert got[i].verdict == ("block" if hits else "allow")
        assert not hits or got[i].confidence == max(r["confidence"] for r in hits)


def test_edge_rows(spark):
    none = spark.createDataFrame([], "url string, bad boolean")
    assert U.mine(none) == [] and U.mine(spark.createDataFrame([("http://a.b/c", False)], "url string, bad boolean")) == []
    df = spark.createDataFrame([(None, None), (1, "http://a.net/es/"), (1, "http://a.net/es/"), (2, "x" * 100000)], "page_id long, url string")
    assert sorted(str((r.page_id, r.verdict)) for r in U.judge(df, []).collect()) == sorted(["(None, 'allow')", "(1, 'block')", "(1, 'block')", "(2, 'allow')"])
    assert U.judge(df.limit(0), []).count() == 0


def test_document_number(spark):
    urls = ["http://a.com/en/12?page=3", "https://b.net/45.html", "http://c.org/x", None, "http://d.org/en/7/"]
    got = spark.createDataFrame([(u,) for u in urls], "url string").select(U.document_number(U.F.col("url"))).collect()
    assert [r[0] for r in got] == [12, 45, None, None, 7]


def test_chance_makes_no_rules(spark):
    rnd = random.Random(4)
    data = [(f"http://{rnd.choice('abcdefgh')}{rnd.choice('klmnop')}.example.org/{rnd.choice(['en', 'de', 'fr'])}/{i}", rnd.random() < 0.25) for i in range(900)]
    assert U.mine(spark.createDataFrame(data, "url string, bad boolean")) == []
    sure = [(f"http://pills.example.org/en/{i}", True) for i in range(40)]
    found = U.mine(spark.createDataFrame(data + sure, "url string, bad boolean"))
    assert found and all("pills" in " ".join(r["tokens"]) for r in found)
    assert not U.surely(2, 2, 0.5, 0.05) and not U.surely(1, 2, 0.5, 0.05) and U.surely(40, 40, 0.5, 1e-6)
