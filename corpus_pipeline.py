"""A training-data pipeline of five stages; each takes the documents that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import classifier, packing, rules, simhash, suffix
from corpusloom.llm.common import table, written

#: A repeated passage goes if it has over 50 words; so many words of prose have at least this many bytes.
PASSAGE_WORDS, PASSAGE_BYTES, PASSAGE_GRAM = 51, 240, 32


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and every risk-controlled rule; a null or empty text fails, repeated rows stay."""
    return rules.keep_good(docs, table(spark, sf_dir, "labels"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that very probably have the highest grade; each row is scored by itself, a null text as an empty one."""
    return classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five-word shingles, Jaccard similarity of 0.8 or more.

    Rows count by themselves, so exactly repeated rows, and rows with null ids, leave one.
    """
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of over 50 words (and 240 bytes or more) that occur earlier.

    A document that is all copy stays with an empty text; a null text stays null.
    """
    return suffix.without_copies(docs, keep="first", length=PASSAGE_BYTES, gram=PASSAGE_GRAM, min_words=PASSAGE_WORDS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens; a null text is packed as an empty one."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", substring_dedup),
    ("best-fit packing", best_fit_packing),
]
#: SQL has no tokenizer and no trained classifier; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each stage's result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
