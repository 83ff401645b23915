"""The whole flow, captions to scored files, over many videos at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.operators.events import reanchor
from scriptloom.operators.extract import ExtractConfig, ModelClient, context_before, deep_extract
from scriptloom.operators.replay import replay
from scriptloom.operators.segment import SegmentConfig, segment
from scriptloom.operators.transcript import normalize
from scriptloom.operators.verify import confidence

REPLY = "struct<events: array<struct<seq: int, op: string, file: string, anchor: string, code: string>>>"


def events_of(replies: DataFrame) -> DataFrame:
    rows = replies.filter("reply is not null").select("video_id", "chunk_id", F.posexplode(F.from_json("reply", REPLY)["events"]).alias("pos", "e"))
    return reanchor(rows.select("video_id", "chunk_id", "pos", "e.*")).filter("chunk_ok").withColumn("ord", F.col("pos"))


def assemble(lines: DataFrame, kept: DataFrame, client: ModelClient, config: ExtractConfig, shape: SegmentConfig = SegmentConfig()) -> DataFrame:
    """(video_id, file, program_type, confidence) from timed lines; ``kept`` names the chunks that passed triage.
    Replies should be written before they are used again: a model must not be asked twice for one chunk."""
    chunks = segment(normalize(lines), shape).join(kept.select("video_id", "chunk_id"), ["video_id", "chunk_id"], "left_semi")
    replies = deep_extract(context_before(chunks, "video_id", "chunk_no"), client, config)
    return confidence(replay(events_of(replies)).select("video_id", "file", "content"))
