"""A streaming form of the quality reports over run events. The batch library has no streams; this is an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_quality(events: DataFrame, window: str = "1 hour", late: str = "30 minutes", slow: float = 60.0) -> DataFrame:
    """Per window and tool: runs, failures, slow runs, mean runtime. Works on a stream or a table ``(ts, event_type, value)``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need a time with a zone
    grouped = timed.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return grouped.agg(F.count("*").alias("runs"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("value") > slow).alias("slow"), F.avg("value").alias("mean_s")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "runs", "failed", "slow", "mean_s")
