"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between block tags, each with the tags, classes and ids of its ancestors.
Features of a block (ancestors, own tag, length, links, punctuation) and of its neighbourhood (transitions) score the
label sequences content / other; the weights are fitted by maximum conditional likelihood on labelled pages and the best
sequence is found by Viterbi. Labelled pages are a bounded sample (``SAMPLE``) of pages whose text is known, aligned
block by block, and a few hand-labelled layouts that cover page parts which a corpus may lack.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most aligned pages that the fit reads, and the most blocks of one of them that it takes.
SAMPLE, SAMPLE_BLOCKS = 400, 200
L2, STEPS = 0.02, 200
BLOCKS = frozenset(
    "html head title body article section main header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption form "
    "fieldset legend label button select option textarea blockquote pre figure figcaption address details summary dialog hr center noscript iframe template".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = re.compile(r"</(script|style|textarea|title)\b", re.I)
#: A tag is found once and never scanned again: quantifiers are possessive, and what is never closed takes the rest of the page.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)""", re.S)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
WORD = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("text", "tags", "names", "linked")

    def __init__(self, text: str, tags: tuple[str, ...], names: frozenset[str], linked: int):
        self.text, self.tags, self.names, self.linked = text, tags, names, linked


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order; text in scripts, styles and comments is none.

    One pass over the page. A quote opens a value only after an equals sign; a tag, comment or declaration that is
    never closed takes the rest of the page, as parsers of HTML have it.
    """
    page = page or ""
    out: list[Block] = []
    # a tag, and all tags and names from the outermost one to it
    stack: list[tuple[str, frozenset[str], frozenset[str]]] = []
    empty: frozenset[str] = frozenset()
    parts: list[str] = []
    linked, link = 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            own, inside, names = stack[-1] if stack else ("", empty, empty)
            out.append(Block(text, (*sorted(inside - {own}), own) if own else (), names, min(linked, len(text))))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw)
            parts.append(text)
            linked += len(text) * (link > 0)

    at = 0
    while True:
        m = TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                parts.append(m[0][9:].removesuffix("]]>"))
            continue
        if not m[1] and name in ("script", "style"):
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "br":
            parts.append(" ")
        elif name == "a":
            link = 0 if m[1] else 1
        if name not in BLOCKS:
            continue
        flush()
        if m[1]:
            if stack and name in stack[-1][1]:
                while stack.pop()[0] != name:
                    pass
                link = 0
            continue
        if stack and stack[-1][0] == "p" or stack and stack[-1][0] == name and name in ("li", "td", "th", "tr", "dt", "dd", "option"):
            stack.pop()  # closed by the next block
        if name not in VOID and not m[3].endswith("/"):
            _, inside, names = stack[-1] if stack else ("", empty, empty)
            mine = frozenset(w for x in NAMES.finditer(m[3]) for w in WORD.findall((x[2] or x[3] or x[4] or "").lower()))
            stack.append((name, inside if name in inside else inside | {name}, names if mine <= names else names | mine))
    flush()
    return out


def features(page: list[Block]) -> list[list[str]]:
    """Names of the binary features of each block."""
    out = []
    for i, b in enumerate(page):
        words = b.text.count(" ") + 1
        f = ["bias", "words:" + str(words.bit_length()), "links:" + str(4 * b.linked // max(1, len(b.text)))]
        f += ["in:" + t for t in set(b.tags)] + ["name:" + n for n in b.names]
        f.append("tag:" + (b.tags[-1] if b.tags else ""))
        f.append("end:" + ("stop" if b.text[-1] in ".!?。！？…\"'»" else "other"))
        if "©" in b.text or "(c) " in b.text.lower():
            f.append("copyright")
        f += ["first"] * (i == 0) + ["last"] * (i == len(page) - 1)
        out.append(f)
    return out


class Crf:
    """Two labels: 0 other, 1 content. ``weights`` favour content; ``moves[a, b]`` scores label b after a."""

    def __init__(self, weights: dict[str, float], moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def decode(self, page: list[Block]) -> list[int]:
        """Viterbi."""
        if not page:
            return []
        get, (m00, m01), (m10, m11) = self.weights.get, *self.moves.tolist()[:1], *self.moves.tolist()[1:]
        a = b = 0.0
        back = []
        for i, f in enumerate(features(page)):
            e = sum(get(x, 0.0) for x in f)
            if i:
                zero, one = a + m00 >= b + m10, a + m01 >= b + m11
                back.append((0 if zero else 1, 0 if one else 1))
                a, b = (a + m00 if zero else b + m10), (a + m01 if one else b + m11) + e
            else:
                b = e
        label = int(b > a)
        out = [label]
        for prev in reversed(back):
            label = prev[label]
            out.append(label)
        return out[::-1]


def fit(pages: list[tuple[list[list[str]], list[int]]], l2: float = L2, steps: int = STEPS) -> Crf:
    """Maximum conditional likelihood with an L2 penalty, by Adam; forward and backward run over all pages at once."""
    pages = [p for p in pages if p[0]]
    names = sorted({x for f, _ in pages for block in f for x in block})
    number = {x: i for i, x in enumerate(names)}
    n, most, d = len(pages), max((len(f) for f, _ in pages), default=0), len(names)
    if not n:
        return Crf({}, np.zeros((2, 2)))
    size = np.array([len(f) for f, _ in pages])
    where = np.concatenate([np.repeat(p * most + np.arange(len(f)), [len(b) for b in f]) for p, (f, _) in enumerate(pages)])
    idx = np.array([number[x] for f, _ in pages for b in f for x in b])
    y = np.zeros((n, most), int)
    for p, (_, labels) in enumerate(pages):
        y[p, : len(labels)] = labels
    on = np.arange(most) < size[:, None]
    pair = on[:, 1:]
    theta, m, v = np.zeros(d + 4), np.zeros(d + 4), np.zeros(d + 4)
    seen = np.concatenate([np.bincount(idx, (y.ravel() * on.ravel())[where], d), np.bincount((2 * y[:, :-1] + y[:, 1:])[pair], minlength=4)])
    for step in range(1, steps + 1):
        e1 = np.bincount(where, theta[:d][idx], n * most).reshape(n, most)
        emit = np.stack([np.zeros_like(e1), e1], axis=2)
        t = theta[d:].reshape(2, 2)
        fwd, bwd = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        fwd[:, 0] = emit[:, 0]
        for i in range(1, most):
            fwd[:, i] = emit[:, i] + np.logaddexp.reduce(fwd[:, i - 1, :, None] + t, axis=1)
        for i in range(most - 2, -1, -1):
            step_back = np.logaddexp.reduce(t + (emit[:, i + 1] + bwd[:, i + 1])[:, None, :], axis=2)
            bwd[:, i] = np.where(on[:, i + 1, None], step_back, 0.0)
        z = np.logaddexp.reduce(fwd[np.arange(n), size - 1], axis=1)
        p1 = np.exp(fwd[:, :, 1] + bwd[:, :, 1] - z[:, None]) * on
        both = np.exp(fwd[:, :-1, :, None] + t + (emit[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pair[:, :, None, None]
        want = np.concatenate([np.bincount(idx, p1.ravel()[where], d), both.sum((0, 1)).ravel()])
        g = (want - seen) / n + l2 * theta / 10
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Crf(dict(zip(names, theta[:d].tolist())), theta[d:].reshape(2, 2))


_LOREM = "The committee met on Monday to discuss the plan for the new bridge over the river. Several members spoke about its cost and the time that it would take to build."
_SHORT = "A short closing paragraph follows here."


@lru_cache(maxsize=1)
def layouts() -> list[tuple[list[list[str]], list[int]]]:
    """Hand-labelled pages: parts in ``yes`` are content, parts in ``no`` are not."""
    yes = [f"<h1>A new bridge</h1><p>{_LOREM}</p><h2>Costs</h2><p>{_LOREM} {_LOREM}</p><ul><li>First point of the plan.</li><li>Second point of the plan.</li></ul><p>{_SHORT}</p>",
           f"<h1>News</h1><p>{_SHORT}</p>", f"<p>{_LOREM}</p><blockquote>{_SHORT}</blockquote><pre>x = 1</pre><table><tr><td>1</td><td>2</td></tr></table>", f"<p>{_LOREM}</p>" * 6]
    links = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("Home", "News", "About", "Contact"))
    above = [f"<nav><ul>{links}</ul></nav>", f"<header><div class='logo'>The Daily Page</div><ul class='menu'>{links}</ul></header>", f"<div id='menu'>{links}</div>",
             "<div class='cookie notice'><p>We use cookies to make this site better. Read our policy.</p><button>Accept</button></div>",
             "<div class='ad'>Buy the best shoes in town today.</div>", "<div class='advert banner'><p>Sale! Fifty percent off.</p></div>", "<div class='notice'>This page needs a newer browser.</div>", ""]
    below = ["<footer>&copy; 2020 The Daily Page &middot; All rights reserved.</footer>", f"<aside class='sidebar'><h3>Popular</h3><ul>{links}</ul><p>{_LOREM}</p></aside>", f"<div class='sidebar'><p>{_LOREM}</p></div>",
             f"<section class='comments' id='comments'><h3>Comments</h3><div class='comment'><p>Anna: {_LOREM}</p></div><div class='comment'><p>I agree with this.</p></div></section>",
             f"<div id='comments'><p>Great article, thanks!</p><p>{_LOREM}</p></div>", "<form><label>Your e-mail</label><p>Sign up for our newsletter.</p><button>Send</button></form>",
             "<div class='related'><h3>Related</h3><a href='/x'>Another story about the bridge</a></div>", "<div class='share social'><a href='#'>Share</a> <a href='#'>Tweet</a></div>", ""]
    out = []
    for i, body in enumerate(yes):
        for j, top in enumerate(above):
            low = below[(i + j) % len(below)] + below[(i + 3 * j + 1) % len(below)]
            inner = ["", "<div class='ad'>Try our new app for free.</div>", below[(2 * i + j + 3) % len(below)]][(i + j) % 3]  # what an article may hold besides
            holder = [("<article>", "</article>"), ("<main><div class='content'>", "</div></main>"), ("<div class='post body'>", "</div>")][(i + 2 * j) % 3]
            pieces = [("<head><title>A new bridge</title></head>", 0), (top, 0), (holder[0] + body, 1), (inner, 0), (f"<p>{_SHORT}</p>" if inner else "", 1), (holder[1] + low, 0)]
            whole, labels = "<html>", []
            for text, label in pieces:
                before = len(blocks(whole))
                whole += text
                labels += [label] * (len(blocks(whole)) - before)
            out.append((features(blocks(whole)), labels))
    return out


def align(page: list[Block], known: str) -> list[int]:
    """1 for blocks that are a line of the known text, or a heading that begins it; what stands in the page's head is no content."""
    lines = {" ".join(x.split()) for x in known.split("\n")}
    whole = " ".join(known.split())
    return [int(not {"head", "title"} & set(b.tags) and (b.text in lines or (bool(b.tags) and b.tags[-1] in ("h1", "h2", "h3") and whole.startswith(b.text)))) for b in page]


def train(labelled: DataFrame | None, sample: int = SAMPLE, most_blocks: int = SAMPLE_BLOCKS) -> Crf:
    """A model from at most ``sample`` rows of ``labelled(html, known)``, of each the first ``most_blocks`` blocks, and the hand-labelled layouts.

    Both bounds concern the fit only; ``extract`` reads whole pages.
    """
    rows = labelled.orderBy(F.xxhash64("html"), "html").limit(sample).collect() if labelled is not None else []
    pages = [(p, align(p, r.known or "")) for r in rows for p in [blocks(r.html)[:most_blocks]]]
    return fit([(features(p), y) for p, y in pages if any(y)] + layouts() * max(1, len(rows) // 64))


def extract(pages: DataFrame, model: Crf) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages(page_id, url, html)``.

    A null or empty page has an empty text. Rows with a null or repeated page_id keep their rows; other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page in b.column(2).to_pylist():
                found = blocks(page)
                out.append("\n".join(x.text for x, y in zip(found, shared.value.decode(found)) if y))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def labelled_pages(pages: DataFrame, docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(html, known): a bounded sample of pages whose path names a document, with that document's text.

    The sample is chosen by URL alone; only its pages' html is read into it. Rows with one URL count as one there.
    """
    from .urls import document_number

    taken = pages.where("html is not null").select("url", document_number(F.col("url")).alias("_n")).where("_n is not null").distinct()
    taken = F.broadcast(taken.orderBy(F.xxhash64("url"), "url").limit(sample))
    html = pages.select("url", "html").join(taken, "url").where("html is not null").groupBy("url", "_n").agg(F.min("html").alias("html"))
    # at most ``sample`` documents' texts meet the pages
    known = docs.select(F.col("doc_id").alias("_n"), F.col("text").alias("known")).join(F.broadcast(taken.select("_n").distinct()), "_n")
    return html.join(known, "_n").select("html", "known")
