"""Streams of ticks to bars (an addition of our own: late rows are bounded by a watermark)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars_of_stream(ticks: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Open, high, low, close and count of (event_type, ts, value) by tumbling window."""
    timed = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), F.col("event_type").alias("ticker")).agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").alias("volume")).select("ticker", F.col("window.start").alias("start"), "open", "high", "low", "close", "volume")
