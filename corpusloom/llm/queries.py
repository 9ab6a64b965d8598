"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("fired")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge, labelled_urls, mine

    pages = table(spark, sf_dir, "pages")
    return judge(pages, mine(labelled_urls(pages, table(spark, sf_dir, "labels"))))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sampling import sampled_ids

    return sampled_ids(table(spark, sf_dir, "documents"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import text_media

    return text_media(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract, labelled_pages, train

    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(labelled_pages(pages, table(spark, sf_dir, "documents"))))


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import removal

    return removal(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op9_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .classifier import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from . import rules

    return {"op1_quality_rules": rules.oracle_sql()}
