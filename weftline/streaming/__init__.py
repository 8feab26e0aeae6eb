"""Streaming forms of row-local plans, and windowed counts (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums per event type and tumbling window with a watermark; works on a static table alike."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
