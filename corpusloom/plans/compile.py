"""One lazy plan from documents to linted, merged cards and unified entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunk, clean, dedup, entities, lint, quality
from .llm_stage import compile_chunks, parse_cards
from .shared import written


def prepare(docs: DataFrame, limit: int) -> DataFrame:
    """Clean documents that pass the quality gate, in chunks."""
    good = quality.report(clean.clean_text(docs)).where("acceptable").select("doc_id", "text")
    return chunk.semantic_chunks(good, limit)


def cards_of(chunks: DataFrame, prompts: dict[str, str], make_client) -> DataFrame:
    """Cards of every type from every chunk, with pos in the order of document, chunk, type and card."""
    parts = [parse_cards(compile_chunks(chunks, p, make_client), t) for t, p in prompts.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return written(out.withColumn("pos", F.monotonically_increasing_id()), "cards")


def compile_documents(docs: DataFrame, prompts: dict[str, str], make_client, limit: int = 50_000) -> DataFrame:
    """Valid cards after lint and merge."""
    return dedup.dedup_cards(lint.lint(cards_of(prepare(docs, limit), prompts, make_client)).where("is_valid"))


def unified_entities(raw: DataFrame) -> DataFrame:
    """Unified entities from raw answers (pos, raw)."""
    return entities.unify(entities.parse_entities(raw, "raw"))
