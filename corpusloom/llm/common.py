"""Shared helpers of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.shared import connected_components, small_or_plain, written

__all__ = ["connected_components", "small_or_plain", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
