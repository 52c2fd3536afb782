"""Structured Streaming over detections: counts per time window, late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, kind, n, total): events and values per tumbling window; works on streams and on tables alike.

    An event later than `late` behind the newest one is left out on a stream.
    """
    events = events.withColumn(time, F.col(time).cast("timestamp"))  # a watermark needs a zoned type
    seen = events.withWatermark(time, late) if events.isStreaming else events
    by = seen.groupBy(F.window(time, every).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("w.start").alias("start"), kind, "n", "total")
