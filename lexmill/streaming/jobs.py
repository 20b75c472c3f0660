"""Structured Streaming: windowed counts with watermarks, sessions, deduplication, incremental part merge, outbox."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lexmill.functions import scratch


def event_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "value")


def sliding(events: DataFrame, width: str = "6 hours", step: str = "1 hour", late: str = "2 hours") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def deduplicated(events: DataFrame, key: list[str], late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def drain(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Process all that is there, batch by batch, and stop: the job-queue poll loop. Restarts resume at the checkpoint."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def merge_into(path: str, key: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """Sink that keeps the latest row of each key, written by document: a replayed batch changes nothing."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        from lexmill.operators.metrics import latest_by
        from lexmill.sources.sinks import bucketed, save_by_document

        spark, rows = batch.sparkSession, batch
        if scratch.status(spark, path) == "folder":
            touched = bucketed(batch.select("tenant_id", "doc_id").distinct())
            rows = batch.unionByName(spark.read.parquet(path).join(touched, ["bucket", "tenant_id", "doc_id"], "left_semi").select(batch.columns))
        # Old rows come from the folders being replaced: cut the lineage first.
        save_by_document(scratch.written(latest_by(rows, key, [order]), "merged"), path)

    return sink


def upserts(path: str) -> Callable[[DataFrame, int], None]:
    """Sink for the update mode: each batch's changed rows in a folder of its number; a replayed batch replaces its own."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return sink


def upserted(spark: SparkSession, path: str, schema: StructType, key: list[str]) -> DataFrame:
    """The last state of each key that ``upserts`` wrote."""
    rows = spark.read.schema(schema.add("batch", "long") if "batch" not in schema.names else schema).parquet(path)
    values = [c for c in rows.columns if c not in (*key, "batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*values), "batch").alias("r")).select(*key, "r.*")
