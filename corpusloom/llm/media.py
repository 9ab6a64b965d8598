"""Media columns: interleaved document sequences with payloads resolved by digest.

An HTML page becomes an ordered array of structs: text items and media references, each reference with its
position, digest and caption. Payloads live in a store, one row per digest however many references it
has; a join on the digest brings stored bytes and references together, and items keep position and caption.
A payload is stored losslessly as an 8-bit RGB image (PNG) of 64 pixels, 192 bytes, a row.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW, WIDTH = 192, 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
ITEM = "struct<position:int,kind:string,text:string,digest:string,n_bytes:long>"
#: Rows of a batch that are held as images at a time.
CHUNK = 64


def payload(text: bytes | None) -> bytes:
    """The text with bytes 32 appended up to a positive multiple of 192."""
    data = text or b""
    return data + b" " * (-len(data) % ROW if data else ROW)


def store_image(data: bytes) -> bytes:
    """A payload as PNG; equal payloads give equal files."""
    if not data or len(data) % ROW:
        raise ValueError("a payload is a positive multiple of 192 bytes")
    height = len(data) // ROW
    lines = np.zeros((height, ROW + 1), np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = np.frombuffer(data, np.uint8).reshape(height, ROW)

    def part(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", WIDTH, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes(), 1)) + part(b"IEND", b"")


def read_image(stored: bytes) -> bytes:
    """The samples of a PNG that ``store_image`` wrote; checks every chunk."""
    if stored[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, body = 8, []
    while at < len(stored):
        size, kind = struct.unpack_from(">I4s", stored, at)
        data = stored[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", stored, at + 8 + size)[0]:
            raise ValueError("a damaged chunk")
        body += [data] * (kind == b"IDAT")
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, ROW + 1)
    if lines[:, 0].any():
        raise ValueError("only filter type 0 is written")
    return lines[:, 1:].tobytes()


def features(samples: bytes) -> str:
    """Size, channel means in thousandths, mean absolute step between rows, distinct values."""
    x = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH, 3)
    means = (1000 * x.sum((0, 1), dtype=np.int64) // (x.shape[0] * WIDTH)).tolist()
    step = int(1000 * np.abs(np.diff(x.astype(np.int16), axis=0)).sum(dtype=np.int64) // max(1, (x.shape[0] - 1) * ROW))
    return f"{WIDTH}x{x.shape[0]};mean={means[0]},{means[1]},{means[2]};step={step};values={np.unique(x).size}"


class _Sequence(HTMLParser):
    """Ordered text and media items; the caption of a figure belongs to the media in it."""

    BLOCKS = {"p", "div", "figure", "figcaption", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "td", "body", "br"}
    SILENT = {"script", "style", "head", "noscript", "template"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.silent = 0
        self.figure: list[dict] | None = None
        self.caption = False

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if not text:
            return
        if self.caption and self.figure is not None:
            for m in self.figure:
                m["text"] = f"{m['text']} {text}".strip() if m["text"] else text
        else:
            self.items.append({"kind": "text", "text": text, "digest": None, "n_bytes": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SILENT:
            self.silent += 1
        if tag in self.BLOCKS:
            self.flush()
        if tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.caption = True
        elif tag in ("img", "audio", "video", "source"):
            a = dict(attrs)
            if (a.get("src") or "").startswith("sha256:"):
                self.flush()
                size = a.get("data-bytes") or ""
                m = {"kind": "media", "text": a.get("alt") or None, "digest": a["src"][7:], "n_bytes": int(size) if size.isdecimal() else None}
                self.items.append(m)
                if self.figure is not None:
                    self.figure.append(m)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        if tag in self.BLOCKS:
            self.flush()
        if tag == "figcaption":
            self.caption = False
        elif tag == "figure":
            self.figure = None

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.words.append(data)


def sequence(page: str | None) -> list[dict]:
    """The ordered items of one page; a media item's text is its caption (or its alt text)."""
    p = _Sequence()
    p.feed(page or "")
    p.close()
    p.flush()
    return [{"position": i, **x} for i, x in enumerate(p.items)]


def sequences(pages: DataFrame, key: str) -> DataFrame:
    """(key, items) for each row of ``pages(key, html)``; a null page has no items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("n_bytes", pa.int64())]))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sequence(x) for x in b.column(1).to_pylist()], kind)], names=[key, "items"])

    return pages.select(F.col(key).cast("long").alias(key), F.col("html").cast("string")).mapInArrow(run, f"`{key}` long, items array<{ITEM}>")


def store(texts: DataFrame, column: Column) -> DataFrame:
    """(digest, media): one stored image for each different payload; copies are dropped before the shuffle, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for big in batches:
            for b in (big.slice(at, CHUNK) for at in range(0, big.num_rows, CHUNK)):
                out = {}
                for t in b.column(0).cast(pa.binary()).to_pylist():
                    data = payload(t)
                    digest = hashlib.sha256(data).hexdigest()
                    if digest not in seen and digest not in out:
                        out[digest] = store_image(data)
                seen |= out.keys()
                if len(seen) > 200_000:  # bounded: what comes again is merged after the shuffle
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.binary())], names=["digest", "media"])

    # copies from other tasks meet here; a digest's rows are equal, so any one will do
    return texts.select(column.cast("string")).mapInArrow(run, "digest string, media binary").dropDuplicates(["digest"])


def read_back(media: DataFrame) -> DataFrame:
    """Per digest: what the stored bytes say when they are read again."""
    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for digest, stored in zip(b.column(0).to_pylist(), b.column(1)):
                stored = stored.as_py()
                data = read_image(stored)
                out.append((digest, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), features(data)))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 7, kinds)], names=names)

    return media.select("digest", "media").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def resolve(items: DataFrame, key: str, facts: DataFrame) -> DataFrame:
    """One row per media reference: key, position, caption, n_bytes, and the columns of ``facts`` for its digest.

    A reference without a stored payload keeps its row, with nulls.
    """
    refs = items.select(key, F.explode("items").alias("i")).where("i.kind = 'media'")
    return refs.select(key, "i.position", F.col("i.text").alias("caption"), "i.n_bytes", F.col("i.digest").alias("digest")).join(facts, "digest", "left")


def as_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, html): a page for each document that shows its payload as a figure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                caption = html.escape(f"text of document {i}")
                out.append(f'<article><p>Document {i}</p><figure><img src="sha256:{hashlib.sha256(payload(t)).hexdigest()}" data-bytes="{len(t or b"")}"><figcaption>{caption}</figcaption></figure></article>')
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "html"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, html string")


def text_media(docs: DataFrame) -> DataFrame:
    """For each row of ``docs(doc_id, text)``: its payload, stored, resolved by digest and read back.

    A null text counts as empty: a payload of 192 blanks. Repeated rows and null doc_ids keep their rows; other columns
    are ignored.
    """
    got = resolve(sequences(as_pages(docs), "doc_id"), "doc_id", read_back(store(docs, F.col("text"))))
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
