"""Pause-separated sessions on a stream of timed lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pause_sessions(lines: DataFrame, pause_gap: float, lateness: str = "1 minute") -> DataFrame:
    """Sessions (video_id, first, last, n) of lines (video_id, at timestamp, seconds): a line extends its session by
    its own length and the gap. Works on static and streaming input alike; late lines are dropped by the watermark."""
    gap = F.concat(((F.col("seconds") + F.lit(pause_gap)) * 1000).cast("long").cast("string"), F.lit(" milliseconds"))
    w = F.session_window("at", gap)
    return lines.withWatermark("at", lateness).groupBy("video_id", w.alias("w")).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n")).drop("w")
