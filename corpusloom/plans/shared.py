"""Written intermediate tables, size checks before a broadcast, and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: A table is broadcast only if it was counted and has at most this many (short) rows.
BROADCAST_ROWS = 50_000
#: Edges that one task of ``connected_components`` contracts, and rows of a batch it gives back.
TASK_EDGES, BATCH = 1 << 16, 1 << 14


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the cluster's spark.checkpoint.dir.

    Only where none is named and the master is local (tests on one machine) a folder of our own is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    The files survive the loss of any executor, so nothing upstream runs twice.
    """
    path = f"{shared_dir(df.sparkSession)}/corpusloom/{os.getpid()}-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_or_plain(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it really has at most ``limit`` rows, else unchanged."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For edges, each node that is not the smallest of its component, and that smallest one."""
    ids, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    root = np.arange(len(ids))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low < high
        x, y = x[apart], y[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    node = np.flatnonzero(root != np.arange(len(ids)))
    return ids[node], ids[root[node]]


def _contracted(edges: DataFrame) -> tuple[DataFrame, bool]:
    """The same components in as few edges as each task of up to TASK_EDGES finds; true if one task has seen all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if part:
            node, low = stars(*(np.concatenate(x) for x in zip(*part)))
            for at in range(0, len(node), BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + BATCH], t.type) for x, t in zip((node, low), schema)], schema=schema)

    schema = to_arrow_schema(edges.schema)
    tasks = -(-edges.count() // TASK_EDGES)
    if not tasks:
        return edges, True
    few = edges.coalesce(1) if tasks == 1 else edges.repartition(tasks)
    return written(few.mapInArrow(run, edges.schema), "edges"), tasks == 1


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for each node of ``edges(a, b)``; component is the smallest node reachable.

    Tasks contract TASK_EDGES edges at a time to stars. While that takes more than one task, alternating large-star and
    small-star rounds on DataFrames join the stars; each step is written to the shared folder. A hub's minimum is
    pre-aggregated on the map side; the join back is an ordinary equi-join, which adaptive execution splits when one hub
    is hot. Nulls and loops are dropped.
    """
    now = written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    for _ in range(max_rounds):
        now, whole = _contracted(now)
        if whole:
            break
        # settled: every node leads to one other node, which leads to none
        now = written(now.distinct(), "edges")
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 or up > 0 and root > 0").isEmpty():
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        now = written(small, "edges")
    else:
        raise RuntimeError("components did not settle")
    # every edge now leads straight from a node to the smallest node of its component
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
