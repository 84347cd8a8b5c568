"""Scan events as a stream: progress, windows, change feed, scheduled digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events with a watermark; zoneless times are UTC."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, size: str = "1 day") -> DataFrame:
    return events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "1 day", step: str = "6 hours") -> DataFrame:
    return events.groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def progress_feed(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Deliver each batch of progress rows to a sink; restarts resume at the checkpoint."""
    return events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def due(apps: DataFrame, now: F.Column) -> DataFrame:
    """Apps whose schedule has run out and that are neither waiting nor running."""
    elapsed = F.unix_timestamp(now) - F.unix_timestamp("scanned_at")
    return apps.where((F.col("schedule_minutes") > 0) & ~F.coalesce(F.col("status"), F.lit("")).isin("Scanning", "Queued") & (F.col("scanned_at").isNull() | (elapsed >= F.col("schedule_minutes") * 60)))


def digest_due(apps: DataFrame, now: F.Column, days: int = 7) -> DataFrame:
    return apps.where(F.col("digest_enabled") & (F.coalesce("webhook", F.lit("")) != "") & (F.col("digest_sent_at").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("digest_sent_at") >= days * 86400)))
