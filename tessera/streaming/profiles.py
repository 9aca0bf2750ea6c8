"""Contingency tables and profiles kept up to date over an event stream: counts and sums are decomposable, so a window's
state is one row a cell. Late events within the watermark still count; later ones are dropped by the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_contingency(events: DataFrame, a: str, b: str, ts: str = "ts", window: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """start, a_cluster, b_cluster, n for tumbling (or sliding) windows, of a stream or a table."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(w.alias("w"), F.col(a).alias("a_cluster"), F.col(b).alias("b_cluster")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), "a_cluster", "b_cluster", "n")


def windowed_profile(events: DataFrame, cluster: str, value: str, ts: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, cluster, n, mean, fraction (of values above 0)."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(F.window(ts, window).alias("w"), F.col(cluster).alias("cluster"))
    out = out.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.avg(F.when(F.col(value) > 0, 1.0).otherwise(0.0)).alias("fraction"))
    return out.select(F.col("w.start").alias("start"), "cluster", "n", "mean", "fraction")
