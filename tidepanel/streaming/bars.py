"""Bars of an event stream: the same code over a batch or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_bars(events: DataFrame, width: str = "1 day", late: str = "1 hour", key: str = "event_type") -> DataFrame:
    """(date, code, open, high, low, close, n, total) of event-time windows; a stream drops what is later than ``late``."""
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)  # watermarks need a zone
    order = F.struct("ts", "event_id")
    g = events.groupBy(F.window("ts", width).alias("w"), F.col(key).alias("code"))
    out = g.agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("ts"), "code", "open", "high", "low", "close", "n", "total")
