"""Reconciliation of two event streams.

Both sides carry a watermark, so state is bounded by event time: counts per
window compare volumes, and an outer interval join emits the events that found no
partner once the watermark has passed them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_counts(events: DataFrame, time: str, lateness: str, window: str, slide: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """start, end, by.., n: rows of each (tumbling or sliding) window."""
    frame = F.window(time, window, slide) if slide else F.window(time, window)
    grouped = events.withWatermark(time, lateness).groupBy(frame.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def sessions(events: DataFrame, time: str, lateness: str, gap: str, by: str) -> DataFrame:
    """start, end, by, n: runs of events of one key without a gap."""
    grouped = events.withWatermark(time, lateness).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def first_seen(events: DataFrame, keys: list[str], time: str, lateness: str) -> DataFrame:
    """One row of those that repeat a key within the watermark."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def match(source: DataFrame, target: DataFrame, key: str, time: str, lateness: str, apart: str) -> DataFrame:
    """key, source_time, target_time, status for events of the two streams that share a
    key at most ``apart`` from each other, and for those without a partner."""
    s = source.select(F.col(key).alias("s_key"), F.col(time).alias("source_time")).withWatermark("source_time", lateness)
    t = target.select(F.col(key).alias("t_key"), F.col(time).alias("target_time")).withWatermark("target_time", lateness)
    near: Column = F.expr(f"s_key = t_key AND target_time BETWEEN source_time - INTERVAL {apart} AND source_time + INTERVAL {apart}")
    status = F.when(F.col("t_key").isNull(), "MISSING_IN_TARGET").when(F.col("s_key").isNull(), "EXTRA_IN_TARGET").otherwise("MATCHED")
    return s.join(t, near, "full_outer").select(F.coalesce("s_key", "t_key").alias(key), "source_time", "target_time", status.alias("status"))
