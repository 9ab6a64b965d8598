"""The language-model stage as a pluggable hook, and the deterministic parts around it."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text, utrim

CARDS = "array<struct<card_type:string,title:string,content:string,reference:string,original_text:string,evidence:string>>"


class Client(Protocol):
    """What a model client must offer; it is made once per task."""

    def call_json(self, prompt: str) -> str: ...


class Echo:
    """A deterministic stand-in: one card per prompt."""

    def call_json(self, prompt: str) -> str:
        import json

        return json.dumps({"cards": [{"title": prompt[:20], "content": prompt}]}, ensure_ascii=False)


def compile_chunks(chunks: DataFrame, prompt: str, make_client) -> DataFrame:
    """(doc_id, chunk_idx, raw): the model's answer for each chunk; ``{document}`` in the prompt is the chunk's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make_client()
        for b in batches:
            raw = [client.call_json(prompt.replace("{document}", t or "")) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.string())], names=["doc_id", "chunk_idx", "raw"])

    return chunks.select("doc_id", "chunk_idx", "text").mapInArrow(run, "doc_id long, chunk_idx int, raw string")


def pending(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks that an earlier run has not answered."""
    return chunks.join(done.select("doc_id", "chunk_idx"), ["doc_id", "chunk_idx"], "left_anti")


def parse_cards(raw: DataFrame, card_type: str) -> DataFrame:
    """One row per card of an answer, with the type that was asked for."""
    cards = raw.select(*[c for c in raw.columns if c != "raw"], F.explode(F.from_json(F.get_json_object(F.col("raw"), "$.cards"), CARDS)).alias("c"))
    rest = [c for c in raw.columns if c != "raw"]
    return cards.select(*rest, *[F.coalesce(f"c.{n}", F.lit("")).alias(n) for n in ("title", "content", "reference", "original_text", "evidence")], F.lit(card_type).alias("card_type"), F.lit("").alias("source"))


def degrade(c: Column) -> Column:
    """JSON from an answer that is not JSON: a fenced block, else blocks between rules that hold a title, else the raw text; null if blank."""
    fenced = F.regexp_extract(c, r"(?s)```json\n(.*?)\n```", 1)
    other = F.regexp_extract(c, r"(?s)```\n(.*?)\n```", 1)
    ok = lambda x: F.when((utrim(x) != "") & F.try_parse_json(utrim(x)).isNotNull(), utrim(x))
    blocks = F.filter(F.split(c, "---"), lambda b: b.contains("标题"))
    cards = F.to_json(F.struct(F.transform(blocks, lambda b: F.struct(utrim(b).alias("raw_card"))).alias("cards")))
    return F.coalesce(
        ok(fenced), F.when(utrim(other).rlike(r"^[{\[]"), ok(other)), F.when(c.contains("---") & (F.size(blocks) > 0), cards),
        F.when(utrim(c) != "", F.to_json(F.struct(c.alias("raw_text")))),
    )


def answer_text(c: Column) -> Column:
    """The answer in a response: content, else reasoning_content, else top-level content."""
    paths = ("$.choices[0].message.content", "$.choices[0].message.reasoning_content", "$.content[0].text", "$.content")
    return F.coalesce(*[F.when(utrim(F.coalesce(F.get_json_object(c, p), F.lit(""))) != "", F.get_json_object(c, p)) for p in paths])


def usage(c: Column) -> Column:
    """Token counts from either vendor's format."""
    get = lambda *p: F.coalesce(*[F.get_json_object(c, f"$.usage.{x}").cast("long") for x in p], F.lit(0).cast("long"))
    prompt, completion = get("prompt_tokens", "input_tokens"), get("completion_tokens", "output_tokens")
    return F.struct(prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), F.coalesce(F.get_json_object(c, "$.usage.total_tokens").cast("long"), prompt + completion).alias("total_tokens"),
                    get("prompt_tokens_details.cached_tokens", "cache_read_input_tokens").alias("cached_tokens"), get("cache_creation_input_tokens").alias("cache_creation_tokens"))


def blank(c: str) -> Column:
    return utrim(text(c)) == ""


#: The Chinese labels of the card types, for answers that hold cards of several types.
LABELS = {"人物卡": "Person", "术语卡": "Term", "新知卡": "Knowledge", "金句卡": "Quote", "行动卡": "Action", "反常识卡": "CounterIntuit", "综述卡": "Review"}


def card_type_of(label: Column) -> Column:
    """The type of a label; null for any other."""
    return F.get(F.filter(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in LABELS.items()]), lambda x: x["a"] == label), F.lit(0))["b"]


def parse_unified(raw: DataFrame) -> DataFrame:
    """One row per card of an answer with several types; an unknown label is Knowledge."""
    rest = [c for c in raw.columns if c != "raw"]
    c = raw.select(*rest, F.explode(F.from_json(F.get_json_object(F.col("raw"), "$.cards"), CARDS)).alias("c"))
    return c.select(*rest, *[F.coalesce(f"c.{n}", F.lit("")).alias(n) for n in ("title", "content", "reference", "original_text", "evidence")], F.coalesce(card_type_of(F.col("c.card_type")), F.lit("Knowledge")).alias("card_type"), F.lit("").alias("source"))


class Patient:
    """A client with up to ``attempts`` tries, growing waits, a least time between calls, and no empty answers.

    ``calls_per_minute`` is this task's share: the global rate divided by the number of tasks that run at once.
    """

    def __init__(self, client: Client, attempts: int = 3, wait: float = 2.0, calls_per_minute: float | None = None):
        self.client, self.attempts, self.wait = client, attempts, wait
        self.pause, self.next = (60.0 / calls_per_minute if calls_per_minute else 0.0), 0.0

    def call_json(self, prompt: str) -> str:
        import time

        last: Exception | None = None
        for k in range(self.attempts):
            if k:
                time.sleep(self.wait * 2 ** (k - 1))
            now = time.monotonic()
            if now < self.next:
                time.sleep(self.next - now)
            self.next = max(now, self.next) + self.pause
            try:
                got = self.client.call_json(prompt)
            except (ConnectionError, TimeoutError, ValueError) as e:
                last = e
                continue
            if got.strip() not in ("", "{}", "[]"):
                return got
            last = ValueError("an empty answer")
        raise RuntimeError(f"no answer after {self.attempts} attempts") from last


#: Answers are kept for 30 days, and at most 200 sets of them.
CACHE_DAYS, CACHE_SETS, CACHE_VERSION = 30, 200, 1


def cache_key(document: Column, provider: str, model: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(provider), F.lit(model), document), 256)


def cache_write(answers: DataFrame, path: str, provider: str, model: str) -> None:
    """Append ``answers(doc_id, chunk_idx, document, raw)`` under their keys."""
    d = answers.withColumn("key", cache_key(F.col("document"), provider, model)).withColumn("version", F.lit(CACHE_VERSION)).withColumn("at", F.current_timestamp())
    d.drop("document").write.mode("append").parquet(path)


def cache_read(cache: DataFrame, chunks: DataFrame, provider: str, model: str) -> DataFrame:
    """(doc_id, chunk_idx, raw): the newest kept answer of each chunk of ``chunks(doc_id, chunk_idx, document)`` that has this version and key."""
    asked = chunks.select("doc_id", "chunk_idx", cache_key(F.col("document"), provider, model).alias("key"))
    kept = cache.where(F.col("version") == CACHE_VERSION).join(asked, ["doc_id", "chunk_idx", "key"])
    return kept.groupBy("doc_id", "chunk_idx").agg(F.max_by("raw", "at").alias("raw"))


def cache_evicted(cache: DataFrame, days: int = CACHE_DAYS, sets: int = CACHE_SETS) -> DataFrame:
    """``cache`` without sets older than ``days`` and without the oldest beyond ``sets``; a set is a key, its age that of its newest row."""
    age = cache.groupBy("key").agg(F.max("at").alias("_at")).where(F.col("_at") >= F.current_timestamp() - F.expr(f"interval {int(days)} days"))
    return cache.join(F.broadcast(age.orderBy(F.desc("_at"), "key").limit(sets).select("key")), "key", "left_semi").select(*cache.columns)
