"""Arithmetic of chunk limits, card targets and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of each card type in a chunk's target.
SHARES = {"Term": 0.22, "Knowledge": 0.22, "CounterIntuit": 0.18, "Action": 0.18, "Person": 0.08, "Quote": 0.08, "Review": 0.04}
CHARS_PER_CARD, MIN_CARDS, MAX_CARDS = 5556.0, 8, 300


def chunk_limit(context_length: Column, max_output_tokens: Column) -> Column:
    """Characters that fit a model: input after the prompt and a margin at 1.3 tokens a character, output at 700 tokens a card."""
    by_input = F.floor(F.greatest(context_length - 2800, F.lit(0)) / 1.3)
    by_output = F.floor(F.greatest(max_output_tokens / 700.0, F.lit(1.0)) * 4000.0)
    return F.greatest(F.least(F.least(by_input, by_output), F.lit(500_000)), F.lit(10_000)).cast("long")


def type_targets(docs: DataFrame, chars: str, chunks: str) -> DataFrame:
    """One row per document and card type with the wanted number of cards a chunk; no characters, no cards."""
    total = F.least(F.greatest(F.ceil(F.col(chars) / CHARS_PER_CARD), F.lit(MIN_CARDS)), F.lit(MAX_CARDS))
    per_chunk = F.ceil(total / F.greatest(F.col(chunks), F.lit(1)))
    each = F.array(*[F.struct(F.lit(t).alias("card_type"), F.when(F.col(chars) == 0, 0).otherwise(F.greatest(F.round(per_chunk * s), F.lit(1))).cast("long").alias("target")) for t, s in SHARES.items()])
    return docs.select("*", F.explode(each).alias("_t")).select(*docs.columns, "_t.card_type", "_t.target")


def route(chars: Column, limit: Column) -> Column:
    return F.when(chars <= limit, "single").otherwise("map_reduce")


def estimated_pages(kilobytes: Column) -> Column:
    return F.least(F.greatest(F.floor(kilobytes / 200), F.lit(1)), F.lit(1000)).cast("long")


def timeout_seconds(pages: Column, scanned: Column) -> Column:
    return F.least(F.greatest(pages * F.when(scanned, 90).otherwise(2), F.lit(60)), F.lit(1800)).cast("long")


def doc_limits(chars: Column) -> Column:
    """Token limits of each step by the document's characters; those of entities, cards and compilation follow its size."""
    scale = lambda by, low, high: F.least(F.greatest(F.floor(chars / by), F.lit(low)), F.lit(high)).cast("int")
    fixed = lambda n, name: F.lit(n).alias(name)
    return F.struct(
        fixed(12000, "summary_input"), fixed(2000, "summary_output"), scale(20, 4000, 8000).alias("entity_output"), fixed(10000, "graph_output"),
        scale(8, 3000, 8000).alias("card_output"), fixed(4000, "index_output"), scale(8, 3000, 8000).alias("compile_output"),
    )


#: The prompt of each card type.
PROMPTS = {"Term": "term_card", "Knowledge": "knowledge_card", "CounterIntuit": "counter_intuit_card", "Quote": "quote_card", "Person": "person_card", "Action": "action_card", "Review": "review_card"}


def prompt_name(card_type: Column) -> Column:
    """The prompt's name of a card type; null for any other."""
    return F.get(F.filter(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in PROMPTS.items()]), lambda x: x["t"] == card_type), F.lit(0))["p"]
