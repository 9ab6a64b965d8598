"""File-drop ingestion with Structured Streaming: each new file is decoded, scored and appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import quality
from ..sources import readers


def document_stream(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files as they arrive, as bytes."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path).select("path", "content")


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Score arriving documents and append them to ``out``; a restart goes on from ``checkpoint``."""

    def one(batch: DataFrame, epoch: int) -> None:
        # a batch that runs again after a failure replaces its own folder
        quality.report(readers.decoded(batch)).select("path", "text", "overall", "grade", "acceptable").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return document_stream(spark, path).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
