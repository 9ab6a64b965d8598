"""Heading-aware chunking with overlap. Sizes are bytes; a chunk's size depends on where the last one ended, so a document's lines run through one state."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADING = re.compile(r"(#{1,3})\s+(.+)\Z")
OVERLAP, HEADROOM, SMALLEST = 2000, 5000, 200


def overlap(body: str, titles: list[str]) -> str:
    """The open titles, a blank line and about the last 2000 bytes, from a line's start."""
    raw = body.encode()
    tail = body
    if len(raw) > OVERLAP:
        tail = raw[len(raw) - OVERLAP :].decode("utf-8", "ignore")
        tail = tail.split("\n", 1)[-1]
    head = "".join(f"{'#' * (i + 1)} {t}\n" for i, t in enumerate(titles))
    return f"{head}\n{tail}" if head else tail


def chunks(text: str, limit: int) -> list[tuple[str, str]]:
    """(title path, text) of each chunk."""
    out: list[tuple[str, str]] = []
    titles: list[str] = []
    parts: list[str] = []
    size = 0

    def flush(again: bool) -> None:
        nonlocal size
        body, path = "".join(parts), " > ".join(titles)
        out.append((path, f"# {path}\n\n{body}" if path else body))
        parts[:] = [overlap(body, titles)] if again else []
        size = len(parts[0].encode()) if again else 0

    for line in text.split("\n"):
        m = HEADING.match(line)
        if m:
            if size >= limit - HEADROOM:
                flush(True)
            del titles[len(m[1]) - 1 :]
            titles.append(m[2].strip())
        parts.append(line + "\n")
        size += len(line.encode()) + 1
        if not m and size >= limit:
            flush(True)
    if "".join(parts).strip():
        flush(False)
    out = [c for c in out if len(c[1].strip().encode()) > SMALLEST]
    return out or ([("", text.strip())] if text.strip() else [])


def semantic_chunks(docs: DataFrame, limit: int, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, chunk_idx, title_path, text); a blank document has no chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, i, path, body) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, (path, body) in enumerate(chunks(t or "", limit))]
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=[key, "chunk_idx", "title_path", "text"])

    return docs.select(F.col(key).cast("long"), F.col(column).cast("string")).mapInArrow(run, f"{key} long, chunk_idx int, title_path string, text string")
