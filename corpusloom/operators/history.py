"""The relational run history as DataFrames: books, compilations, cards, entities, diagnostics, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import written


def recent(compilations: DataFrame, books: DataFrame, n: int) -> DataFrame:
    """The last ``n`` compilations with their books. The top-n runs before the join, so only n rows are joined."""
    last = compilations.orderBy(F.desc("compiled_at"), F.desc("id")).limit(n)
    return last.join(books.select(F.col("id").alias("book_id"), "title", "author"), "book_id").select("id", "book_id", "title", "author", "version", "total_cards", "compiled_at")


def card_stats(cards: DataFrame) -> DataFrame:
    return cards.groupBy("card_type").agg(F.count("*").alias("n"))


def stats(compilations: DataFrame, books: DataFrame) -> DataFrame:
    """One row: books, compilations, cards, reviewed, tokens."""
    a = compilations.agg(F.count("*").alias("n_compilations"), F.coalesce(F.sum("total_cards"), F.lit(0)).alias("n_cards"), F.count_if(F.col("reviewed") == 1).alias("n_reviewed"), F.coalesce(F.max("compiled_at"), F.lit("")).alias("last_compiled_at"))
    return books.agg(F.count("*").alias("n_books")).join(F.broadcast(a))


def next_versions(new: DataFrame, compilations: DataFrame) -> DataFrame:
    """``new(book_id, id, …)`` with version: after the book's last one, in order of id."""
    last = compilations.groupBy("book_id").agg(F.max("version").alias("_last"))
    w = Window.partitionBy("book_id").orderBy("id")
    return new.join(last, "book_id", "left").withColumn("version", F.coalesce("_last", F.lit(0)) + F.row_number().over(w)).drop("_last")


def upsert_books(books: DataFrame, new: DataFrame) -> DataFrame:
    """Merge by source_file: a new value fills only an empty one, sizes follow the newest, compile_count goes up by one."""
    fill, newest = ["title", "author", "publisher", "isbn"], ["page_count", "file_size", "content_hash"]
    b, n = books.alias("b"), new.alias("n")
    both = b.join(n, F.col("b.source_file") == F.col("n.source_file"), "full_outer")
    known, came = F.col("b.source_file").isNotNull(), F.col("n.source_file").isNotNull()
    cols = [F.coalesce("b.source_file", "n.source_file").alias("source_file")]
    cols += [F.when(known & (F.coalesce(f"b.{c}", F.lit("")) != ""), F.col(f"b.{c}")).otherwise(F.coalesce(f"n.{c}", f"b.{c}", F.lit(""))).alias(c) for c in fill]
    cols += [F.when(came, F.col(f"n.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in newest]
    return both.select(*cols, (F.coalesce("b.compile_count", F.lit(0)) + came.cast("long")).alias("compile_count"))


def mark_reviewed(compilations: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select(F.col("id").alias("_id")).distinct()
    return compilations.join(hit, F.col("id") == F.col("_id"), "left").withColumn("reviewed", F.when(F.col("_id").isNotNull(), 1).otherwise(F.col("reviewed"))).drop("_id")


def card_counts(cards: DataFrame, key: str = "compilation_id") -> DataFrame:
    """Per compilation: total, accepted (without any reason), rejected (the rest), degraded, retry."""
    ok = (F.col("status") == "Accepted") & (F.coalesce("reject_reason", F.lit("")) == "")
    return cards.groupBy(key).agg(F.count("*").alias("total_cards"), F.count_if(ok).alias("accepted_cards"), F.count_if(~ok).alias("rejected_cards"), F.count_if(F.col("status") == "Degraded").alias("degraded_cards"), F.count_if(F.col("status") == "NeedsRetry").alias("retry_cards"))


def diagnostics(fails: DataFrame, degradations: DataFrame, retries: DataFrame) -> DataFrame:
    """The three kinds in one long table."""
    tagged = [d.withColumn("diag_type", F.lit(t)) for d, t in ((fails, "fail"), (degradations, "degradation"), (retries, "retry"))]
    return tagged[0].unionByName(tagged[1], allowMissingColumns=True).unionByName(tagged[2], allowMissingColumns=True)


def usage(calls: DataFrame) -> DataFrame:
    """Token sums and integer mean latency by model."""
    return calls.groupBy("model").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.floor(F.sum("latency_ms") / F.count("*")).alias("mean_latency_ms"))


def best_providers(health: DataFrame) -> DataFrame:
    """Available providers first, then by latency."""
    return health.orderBy(F.desc("available"), "latency_ms", "provider")


def unique_ids(cards: DataFrame, base: str, order: str = "pos") -> DataFrame:
    """``cards`` with unique_id, one second apart from ``base`` (yyyyMMddHHmmss) in order. Ranks come from per-range counts, not from one sorted task."""
    n = max(cards.sparkSession.sparkContext.defaultParallelism, 2)
    # written once: a task that runs again cannot rank its rows in another way
    d = written(cards.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "ranked")
    sizes = d.groupBy("_p").agg(F.count("*").alias("c"), F.min("_i").alias("_first"))
    before = sizes.select(F.col("_p"), "_first", (F.sum("c").over(Window.orderBy("_p")) - F.col("c")).alias("_before"))  # one row per partition
    ts = F.to_timestamp(F.lit(base), "yyyyMMddHHmmss")
    at = F.timestamp_seconds(F.unix_timestamp(ts) + F.col("_before") + F.col("_i") - F.col("_first"))
    return d.join(F.broadcast(before), "_p").withColumn("unique_id", F.date_format(at, "yyyyMMddHHmmss")).drop("_p", "_i", "_first", "_before")


#: The tables of the history as DDL; ``ensure_tables`` creates what is missing and ``migrated`` adds missing columns.
SCHEMAS = {
    "books": "id long, source_file string, title string, author string, publisher string, isbn string, page_count long, file_size long, content_hash string, compile_count long, last_success int, last_compiled_at string",
    "compilations": "id long, book_id long, version int, total_cards long, accepted_cards long, rejected_cards long, degraded_cards long, retry_cards long, reviewed int, compiled_at string",
    "summaries": "compilation_id long, title string, overview string, key_points string, structure string",
    "chunks": "compilation_id long, chunk_index long, title_path string, content_preview string, char_count long, entity_count long, card_count long, relation_count long",
    "cards": "compilation_id long, chunk_id string, unique_id string, title string, content string, card_type string, quality_score double, status string, reject_reason string, retry_count long, reference string, source_file string, location string, original_text string, source string, paraphrase string, evidence string, related_cards_json string, degraded_from string, created_at string",
    "entities": "compilation_id long, name string, entity_type string, context string",
    "relations": "compilation_id long, source string, target string, relation_type string",
    "diagnostics": "compilation_id long, diag_type string, stage string, message string, retry_count long, final_status string, expected_count long, actual_count long, success boolean",
}


def migrated(rows: DataFrame, table: str) -> DataFrame:
    """``rows`` in the present schema of a table: missing columns are null, others are left out, kinds are cast."""
    from pyspark.sql.types import StructType

    want = StructType.fromDDL(SCHEMAS[table])
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])


def ensure_tables(spark, path: str) -> None:
    """An empty Parquet table for each of ``SCHEMAS`` that has none under ``path``."""
    from pyspark.sql.utils import AnalysisException

    for name, ddl in SCHEMAS.items():
        try:
            spark.read.parquet(f"{path}/{name}")
        except AnalysisException:
            spark.createDataFrame([], ddl).write.parquet(f"{path}/{name}")


def created_at(unique_id: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss from a 14-digit id, else empty."""
    return F.when(unique_id.rlike(r"^[0-9]{14}\z"), F.regexp_replace(unique_id, r"^(.{4})(..)(..)(..)(..)(..)\z", "$1-$2-$3 $4:$5:$6")).otherwise("")


def child_rows(name: str, rows: DataFrame, **named) -> DataFrame:
    """Rows of a child table from the engine's columns (``named`` gives columns for other names): chunks get an empty preview, cards their time."""
    d = rows.select("*", *[F.col(c).alias(n) for n, c in named.items()])
    if name == "chunks":
        d = d.withColumn("content_preview", F.lit(""))
    if name == "cards":
        d = d.withColumn("created_at", created_at(F.coalesce("unique_id", F.lit(""))))
        if "related_cards" in d.columns:
            d = d.withColumn("related_cards_json", F.coalesce(F.to_json("related_cards"), F.lit("[]")))
    return migrated(d, name)


def record_compilations(path: str, runs: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Append new runs (id, book_id, compiled_at) with versions and card counts, and the rows of each child table; returns the runs.

    Children are appended before the runs: a run that is interrupted leaves no run without its children, and its children's ids are taken again.
    """
    spark = runs.sparkSession
    ensure_tables(spark, path)
    counts = card_counts(children["cards"])
    new = next_versions(runs, spark.read.parquet(f"{path}/compilations")).join(counts, F.col("id") == F.col("compilation_id"), "left").drop("compilation_id")
    new = written(migrated(new.fillna(0, [c for c in counts.columns if c != "compilation_id"]).withColumn("reviewed", F.lit(0)), "compilations"), "runs")
    for name, rows in children.items():
        child_rows(name, rows).write.mode("append").parquet(f"{path}/{name}")
    new.write.mode("append").parquet(f"{path}/compilations")
    return new


def update_status(books: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``books`` with last_success and last_compiled_at of ``outcomes(book_id, success, at)``, the latest of each book."""
    last = outcomes.groupBy("book_id").agg(F.max_by(F.struct(F.col("success").cast("int").alias("s"), "at"), F.struct("at", "success")).alias("_o"))
    d = books.join(last, F.col("id") == F.col("book_id"), "left")
    new = {"last_success": F.coalesce("_o.s", "last_success"), "last_compiled_at": F.coalesce("_o.at", "last_compiled_at")}
    return d.select(*[new[c].alias(c) if c in new else F.col(c) for c in books.columns])
