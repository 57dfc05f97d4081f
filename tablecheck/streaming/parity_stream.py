"""Continuous comparison of two event streams: an extension, since batch parity has no streaming form.

Both streams carry an event time; pairs are joined by key within a tolerance of time, and events that found no partner
before the watermark passed are reported as missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(source: DataFrame, target: DataFrame, time: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, source_rows, target_rows for each window of event time, once it is closed."""
    both = source.select(F.col(time).alias("_t"), F.lit(1).alias("s"), F.lit(0).alias("t")).union(target.select(F.col(time).alias("_t"), F.lit(0).alias("s"), F.lit(1).alias("t")))
    both = both.withColumn("_t", F.col("_t").cast("timestamp"))
    counts = both.withWatermark("_t", late).groupBy(F.window("_t", width)).agg(F.sum("s").alias("source_rows"), F.sum("t").alias("target_rows"))
    return counts.select(F.col("window.start").alias("window_start"), "source_rows", "target_rows")


def unmatched(source: DataFrame, target: DataFrame, key: str, time: str, apart: str = "10 minutes", late: str = "20 minutes") -> DataFrame:
    """Events of the source with the key of their partner, null where none came in time."""
    s = source.select(F.col(key).alias("s_key"), F.col(time).cast("timestamp").alias("s_time")).withWatermark("s_time", late)
    t = target.select(F.col(key).alias("t_key"), F.col(time).cast("timestamp").alias("t_time")).withWatermark("t_time", late)
    near = F.expr(f"s_key = t_key AND t_time BETWEEN s_time - INTERVAL {apart} AND s_time + INTERVAL {apart}")
    return s.join(t, near, "left_outer").select("s_key", "s_time", "t_key")


def session_counts(events: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """key, session start and end, events: sessions that end after a gap."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    out = timed.groupBy(F.col(key), F.session_window("_t", gap)).agg(F.count(F.lit(1)).alias("events"))
    return out.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "events")
