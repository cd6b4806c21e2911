"""Event-time windows over activity; works on a stream and on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events by type and tumbling or sliding window; late rows are dropped after the watermark."""
    given = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if given.isStreaming:
        given = given.withWatermark("ts", late)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return given.groupBy("event_type", w.alias("window")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: runs of events no further apart than the gap."""
    given = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if given.isStreaming:
        given = given.withWatermark("ts", late)
    return given.groupBy("user_id", F.session_window("ts", gap).alias("session")).agg(F.count("*").alias("n"))
