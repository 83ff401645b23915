"""Normalising timed lines (video_id, ord, start, end, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.functions.text import collapse_space


def clamp_overlap(lines: DataFrame, key: str = "video_id") -> DataFrame:
    """Ends a line no later than the next begins and no earlier than itself; the last one is left alone."""
    following = F.lead("start").over(Window.partitionBy(key).orderBy("start", "ord"))
    end = F.when(following.isNull(), F.col("end")).otherwise(F.greatest("start", F.least("end", following)))
    return lines.withColumn("end", end)


def normalize(lines: DataFrame) -> DataFrame:
    """Collapses white space, drops empty lines, clamps overlaps; ties in start keep their input order."""
    return clamp_overlap(lines.withColumn("text", collapse_space(F.col("text"))).filter("text <> ''"))
