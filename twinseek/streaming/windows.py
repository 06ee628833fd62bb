"""Windowed counts over an event log; each works on a static table and, with a watermark, on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late) if events.isStreaming else timed


def tumbling(events: DataFrame, size: str, late: str = "1 hour") -> DataFrame:
    out = _timed(events, late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def sliding(events: DataFrame, size: str, step: str, late: str = "1 hour") -> DataFrame:
    out = _timed(events, late).groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    out = _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


def search_each_batch(queries: DataFrame, search: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Answers a stream of queries micro-batch by micro-batch; a batch that is run again overwrites its own folder."""

    def answer(batch: DataFrame, number: int) -> None:
        search(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).start()
