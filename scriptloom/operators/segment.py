"""Cutting ordered lines into chunks: pauses and cues break hard, caps break softly with a sentence backtrack."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.functions.text import CUES, ends_sentence, starts_with_cue, token_estimate


@dataclass(frozen=True)
class SegmentConfig:
    max_tokens: int = 350
    max_seconds: float = 45.0
    pause_gap: float = 1.5
    cues: tuple[str, ...] = field(default=tuple(CUES))


def hard_groups(lines: DataFrame, config: SegmentConfig) -> DataFrame:
    """Adds hard_group: it rises where the pause exceeds the gap or the text begins with a cue."""
    w = Window.partitionBy("video_id").orderBy("start", "ord")
    gap = F.coalesce(F.col("start") - F.lag("end").over(w) > config.pause_gap, F.lit(False))
    return lines.withColumn("_new", (gap | starts_with_cue(F.col("text"), list(config.cues))).cast("int")).withColumn("hard_group", F.sum("_new").over(w)).drop("_new")


def _fold(lines: Column, config: SegmentConfig) -> Column:
    """Chunks (arrays of lines) of one hard group's ordered lines. The state has the finished chunks, the current one and
    its tokens; a full chunk ends after its last sentence that is not its first line, and the rest is carried over."""
    kind = "array<struct<start: double, ord: bigint, end: double, text: string, tokens: int, stop: boolean>>"
    none = F.array().cast(kind)

    def step(state: Column, line: Column) -> Column:
        cur = state["cur"]
        total = state["total"] + line["tokens"]
        full = (F.size(cur) > 0) & ((total > config.max_tokens) | (line["end"] - F.get(cur, F.lit(0))["start"] > config.max_seconds))
        cut = F.coalesce(F.array_max(F.transform(cur, lambda x, i: F.when((i >= 1) & x["stop"], i + 1))), F.size(cur))
        return F.when(full, F.struct(
            F.concat(state["done"], F.array(F.slice(cur, F.lit(1), cut))).alias("done"),
            F.concat(F.slice(cur, cut + 1, F.size(cur)), F.array(line)).alias("cur"),
            F.aggregate(F.slice(cur, cut + 1, F.size(cur)), line["tokens"], lambda a, x: a + x["tokens"]).alias("total"),
        )).otherwise(F.struct(state["done"].alias("done"), F.concat(cur, F.array(line)).alias("cur"), total.alias("total")))

    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), none.alias("cur"), F.lit(0).alias("total"))
    return F.aggregate(lines, start, step, lambda s: F.when(F.size(s["cur"]) > 0, F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"]))


def segment(lines: DataFrame, config: SegmentConfig = SegmentConfig()) -> DataFrame:
    """(video_id, chunk_id, chunk_no, start, end, text, n_lines, tokens) of normalised lines."""
    line = F.struct(F.col("start").cast("double").alias("start"), F.col("ord").cast("bigint").alias("ord"), F.col("end").cast("double").alias("end"), "text", token_estimate(F.col("text")).alias("tokens"), ends_sentence(F.col("text")).alias("stop"))
    groups = hard_groups(lines, config).groupBy("video_id", "hard_group").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    chunks = groups.select("video_id", "hard_group", F.posexplode(_fold(F.col("lines"), config)).alias("part", "c"))
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("hard_group", "part"))
    return chunks.withColumn("chunk_no", number).select(
        "video_id", F.format_string("c%04d", "chunk_no").alias("chunk_id"), "chunk_no", F.get("c", F.lit(0))["start"].alias("start"),
        F.element_at("c", -1)["end"].alias("end"), F.array_join(F.transform("c", lambda x: x["text"]), " ").alias("text"),
        F.size("c").alias("n_lines"), F.aggregate("c", F.lit(0), lambda a, x: a + x["tokens"]).alias("tokens"),
    )
