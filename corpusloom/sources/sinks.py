"""Writers: cards by type as Parquet and Markdown, usage as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.render import card_markdown


def gate(linted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a card with any reason or another status than Accepted is rejected."""
    return linted.where("not is_gated"), linted.where("is_gated")


def save_cards(cards: DataFrame, path: str) -> None:
    """One folder per card type."""
    cards.write.mode("overwrite").partitionBy("card_type").parquet(path)


def save_markdown(cards: DataFrame, path: str) -> None:
    """Each card's Markdown as text, in one folder per type; files follow the partitions, not the types."""
    cards.select("card_type", card_markdown(cards).alias("value")).write.mode("overwrite").partitionBy("card_type").text(path)


def append_usage(calls: DataFrame, path: str) -> None:
    calls.write.mode("append").json(path)


def markdown_by_type(cards: DataFrame, order: str = "pos") -> DataFrame:
    """(card_type, markdown) for a set of cards that fits a document."""
    d = cards.select("card_type", F.col(order).alias("o"), card_markdown(cards).alias("m"))
    return d.groupBy("card_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "m"))), lambda x: x["m"]), "\n").alias("markdown"))
