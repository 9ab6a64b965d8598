import html
import re
import time
from itertools import product

import numpy as np
import pytest

from corpusloom.llm import html_extract as H

SF = "/root/testdata/sf0.01"


def test_blocks():
    page = """<html><head><title>T &amp; x</title><style>p{}</style></head><body><nav><ul><li><a href="/a">A</a><li><a>B</a></ul></nav>
    <!-- no <p>no</p> --><article class="main-text"><h1>Head</h1><p><b>One<br>two<br><p>three &lt;x&gt;&nbsp; four</p><script>var t="</p>";</script>tail</article><footer>&copy; f</footer>"""
    got = [(b.text, b.tags[-1]) for b in H.blocks(page)]
    assert got == [("T & x", "title"), ("A", "li"), ("B", "li"), ("Head", "h1"), ("One two", "p"), ("three <x> four", "p"), ("tail", "article"), ("© f", "footer")]
    assert "main" in H.blocks(page)[3].names and H.blocks(page)[1].linked == 1
    for odd in (None, "", "<", "a < b > c", "<p", "<p><script>never closed", "x" * 10, "<a href='>'>q</a>", "</p></div>"):
        H.blocks(odd)


def test_viterbi_and_likelihood_equal_enumeration():
    rng = np.random.default_rng(0)
    page = H.blocks("<nav><a>x</a></nav><p>one two.</p><div class='ad'>b</div><p>three</p><footer>f</footer>")
    f = H.features(page)
    names = sorted({x for b in f for x in b})
    for _ in range(50):
        crf = H.Crf({x: rng.normal() for x in names}, rng.normal(size=(2, 2)))
        score = lambda y: sum(crf.weights[x] for b, v in zip(f, y) if v for x in b) + sum(crf.moves[a, b] for a, b in zip(y, y[1:]))
        assert score(crf.decode(page)) == pytest.approx(max(score(y) for y in product((0, 1), repeat=len(f))))


def test_fit_matches_expected_and_observed_counts():
    pages = H.layouts()[:8]
    crf = H.fit(pages, l2=1e-6, steps=400)
    right = total = 0
    for f, y in pages:
        for yy in [y]:
            e = [sum(crf.weights[x] for x in b) for b in f]
            best = max(((sum(a for a, v in zip(e, c) if v) + sum(crf.moves[p, q] for p, q in zip(c, c[1:]))), c) for c in product((0, 1), repeat=min(len(f), 12)))[1] if len(f) <= 12 else None
            if best:
                right += sum(a == b for a, b in zip(best, yy))
                total += len(yy)
    assert right == total


def test_layout_parts_are_told_apart():
    crf = H.train(None)
    text = H._LOREM.replace("bridge", "tunnel").replace("Monday", "Friday")
    page = f"""<html><head><title>t</title></head><body><header><ul class=menu><li><a href=/>Home</a></ul></header><div class="ad">Cheap flights for everyone.</div>
    <article><h1>A tunnel</h1><p>{text}</p><p>{text}</p></article><aside class=sidebar><p>{text}</p></aside>
    <section class="comments"><div class="comment"><p>{text}</p></div></section><form><p>Join our list.</p></form><footer>&copy; me</footer>"""
    b = H.blocks(page)
    assert [x.text for x, y in zip(b, crf.decode(b)) if y] == ["A tunnel", text, text]


def test_held_out_pages(spark):
    """The text of a page is its heading and the lines of the document that its path names."""
    pages, docs = spark.read.parquet(f"{SF}/pages.parquet"), spark.read.parquet(f"{SF}/documents.parquet")
    model = H.train(H.labelled_pages(pages.where("page_id % 2 = 0"), docs))
    number = H.F.regexp_extract("url", r"/(\d+)(?:\.html|/)?(?:[?#].*)?$", 1).cast("long")
    held = pages.where("page_id % 2 = 1").withColumn("n", number).join(docs.select(H.F.col("doc_id").alias("n"), H.F.col("text").alias("known")), "n").select("page_id", "html", "known").collect()
    got = {r.page_id: r.text for r in H.extract(pages.where("page_id % 2 = 1"), model).collect()}
    right = 0
    for r in held:
        lines = [" ".join(x.split()) for x in r.known.split("\n")]
        heading = " ".join(html.unescape(re.search("<h1>(.*?)</h1>", r.html, re.S)[1]).split())
        right += got[r.page_id] == "\n".join([heading, *[x for x in lines if x]])
    assert len(held) > 100 and right / len(held) >= 0.97


def test_hostile_pages_take_linear_time():
    for part in ("<a ", "<p x='", '<a b="', "<![CDATA[", "<!", "<!--", "<div>x", "</div>", "<div class=a>x</p>", "<p>", "<", "<a b=\"'"):
        page = part * (1_000_000 // len(part))
        began = time.process_time()
        H.blocks(page)
        assert time.process_time() - began < 5, part
    assert [b.text for b in H.blocks("<p class=it's>Hello</p><p title='a>b' id=x>you")] == ["Hello", "you"]
    assert [b.text for b in H.blocks("<p>one<p x='never closed>two</p>three")] == ["one", "two", "three"]


def test_rows(spark):
    model = H.train(None)
    rows = [(1, "u", None, 1), (2, None, "", 1), (3, "u", "<p>" + "word and word. " * 50000 + "</p>", 1), (3, "u", "<p>x", 1), (None, "u", "<footer>&copy; x</footer>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = H.extract(df, model).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got if r.page_id in (1, 2)} == {1: "", 2: ""}
    assert H.extract(df.limit(0), model).count() == 0
