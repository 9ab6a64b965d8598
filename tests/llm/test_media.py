import hashlib
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import media as M


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=3000))
def test_round_trip(data):
    p = M.payload(data)
    assert len(p) % 192 == 0 and len(p) >= 192 and p.startswith(data) and not p[len(data) :].strip(b" ")
    assert M.read_image(M.store_image(p)) == p


def test_sequence_keeps_order_captions_and_positions():
    page = """<head><title>no</title></head><p>one <b>two</b></p><figure><img src="sha256:aa" data-bytes="3"><figcaption>cap &amp; tion</figcaption></figure>
    three<img src="http://x/y.png"><script>var no</script><img src="sha256:bb" alt="b"><figure><img src="sha256:cc"><img src="sha256:dd"><figcaption>both</figcaption></figure>four"""
    got = [(x["position"], x["kind"], x["text"], x["digest"], x["n_bytes"]) for x in M.sequence(page)]
    assert got == [(0, "text", "one two", None, None), (1, "media", "cap & tion", "aa", 3), (2, "text", "three", None, None), (3, "media", "b", "bb", None), (4, "media", "both", "cc", None), (5, "media", "both", "dd", None), (6, "text", "four", None, None)]
    assert M.sequence(None) == [] and M.sequence("") == []


def test_text_media_equals_plain(spark):
    texts = [None, "", "a", "é" * 96, "x" * 192, "y" * 193, "same text " * 40, "same text " * 40, "知识\x00\n" * 40000]
    rows = [(i if i else None, t, "q") for i, t in enumerate(texts)] + [(3, texts[3], "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(4)
    got = M.text_media(df).collect()
    assert len(got) == len(rows)
    want = []
    for i, t, _ in rows:
        b = (t or "").encode()
        p = b + b" " * ((192 - len(b) % 192) % 192 or (192 if not b else 0))
        s = M.store_image(p)
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(s), hashlib.sha256(s).hexdigest(), M.features(p), 1, f"text of document {i}"))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert M.text_media(df.limit(0)).count() == 0


def test_unresolved_reference_keeps_its_row(spark):
    pages = spark.createDataFrame([(1, '<img src="sha256:zz"><p>x</p>'), (2, None)], "page_id long, html string")
    facts = M.read_back(M.store(spark.createDataFrame([("a",)], "t string"), M.F.col("t")))
    got = M.resolve(M.sequences(pages, "page_id"), "page_id", facts).collect()
    assert [(r.page_id, r.position, r.digest, r.feature) for r in got] == [(1, 0, "zz", None)]
