"""Windowed metrics of events, the same expression for a table and a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total); a stream waits ``late`` for late events."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    w = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
