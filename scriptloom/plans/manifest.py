"""Skipping work that is done: stage records by content hash."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def config_digest(config) -> str:
    return hashlib.sha256(json.dumps(asdict(config), sort_keys=True, default=str).encode()).hexdigest()


def latest(manifest: DataFrame) -> DataFrame:
    """The last record of each (video_id, stage)."""
    rest = F.struct("input_hash", "status", "finished")
    return manifest.groupBy("video_id", "stage").agg(F.max_by(rest, "finished").alias("r")).select("video_id", "stage", "r.*")


def pending(inputs: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """Inputs (video_id, stage, input_hash, ...) without a done record of the same hash."""
    done = latest(manifest).filter("status = 'done'").select("video_id", "stage", "input_hash")
    return inputs if force else inputs.join(done, ["video_id", "stage", "input_hash"], "left_anti")


def record(outcomes: DataFrame) -> DataFrame:
    """Records of outcomes (video_id, stage, input_hash, failed); a failed stage is not skipped later. An empty hash
    fails the query."""
    status = F.when(F.col("failed"), "failed").otherwise("done")
    empty = F.raise_error(F.concat(F.lit("no input hash for stage "), F.col("stage"))).cast("string")
    known = F.when(F.coalesce("input_hash", F.lit("")) != "", F.col("input_hash")).otherwise(empty)
    return outcomes.select("video_id", "stage", known.alias("input_hash"), status.alias("status"), F.current_timestamp().alias("finished"))
