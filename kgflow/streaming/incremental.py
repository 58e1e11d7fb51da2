"""Structured Streaming: event-time windows, incremental merges, dedup across batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files) if files else r).format(kind).load(path)


def window_counts(events: DataFrame, width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """start, event_type, n, total for tumbling (or sliding) windows; with `late`, events older than the watermark are dropped in a stream."""
    e = events.withWatermark("ts", late) if late else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once_within(df: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Each key once, state kept as long as the watermark allows."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def merge_stream(source: DataFrame, table: str, merge: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str):
    """A query that merges every batch into a Parquet table: merge(old, batch) is written beside the old version, then `current` points to it.

    Versions are named by batch, so a batch that is run again after a failure overwrites its own version only (exactly once).
    """
    from ..sources.io import exists

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = None
        for n in range(number - 1, -1, -1):
            if exists(spark, f"{table}/v={n}/_SUCCESS"):
                old = spark.read.parquet(f"{table}/v={n}")
                break
        (merge(old, batch) if old is not None else batch).write.mode("overwrite").parquet(f"{table}/v={number}")

    return source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
