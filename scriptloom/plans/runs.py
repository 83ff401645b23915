"""The flow over a store of runs: each stage works on the videos whose input has changed, the others are skipped.

A store is a folder of tables, all partitioned by video and by the hash of what a row was made from, so nothing is
overwritten and nothing stale is read: the manifest's last record of a video and stage says which hash counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.functions.text import content_hash, run_id_valid
from scriptloom.operators.extract import ExtractConfig, ModelClient, all_failed, ask_verdicts, context_before, deep_extract, triage
from scriptloom.operators.replay import replay, replay_report
from scriptloom.operators.segment import SegmentConfig, segment
from scriptloom.operators.transcript import normalize
from scriptloom.operators.verify import confidence, findings, metadata, overall
from scriptloom.plans.config import Settings
from scriptloom.plans.flow import events_of
from scriptloom.plans.manifest import config_digest, latest, pending, record
from scriptloom.sources.captions import decode_asr, decode_json3, export_union

MANIFEST = "video_id string, stage string, input_hash string, status string, finished timestamp, n_rows long, video string"
#: The stages, in their order, and the tables of each; the first one's rows are counted.
STAGES = {"fetch": ["transcript"], "segment": ["chunks"], "triage": ["triage"], "extract": ["events"], "assemble": ["files", "assembly"], "verify": ["report", "findings"]}


def folder() -> Column:
    """A video's part of a table: a name that no reader takes for a number."""
    return F.concat(F.lit("v-"), F.col("video_id"))


def rows_hash(videos: DataFrame, rows: DataFrame, columns: list[str], more: str = "") -> DataFrame:
    """(video_id, input_hash) of each video's rows, in any order and if it has none, and of ``more``, such as a digest of
    settings."""
    one = F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    sums = rows.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(one, F.lit(1 << 40))).alias("a"), F.bit_xor(one).alias("b"))
    counts = [F.coalesce(c, F.lit(0).cast("long")) for c in ("n", "a", "b")]
    return videos.join(sums, "video_id", "left").select("video_id", content_hash(F.concat_ws("/", *counts, F.lit(more))).alias("input_hash"))


class Runs:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._unfinished = spark, path.rstrip("/"), []

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def kept(self, rows: DataFrame) -> DataFrame:
        """``rows``, written among the store's unfinished work: what they were made from may change."""
        path = f"{self.path}/unfinished/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        self._unfinished.append(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _forget(self) -> None:
        for name in self._unfinished:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self._unfinished = []

    def manifest(self) -> DataFrame:
        """All records; one that lies under another video's name fails the query."""
        if not self._exists("manifest"):
            return self.spark.createDataFrame([], MANIFEST)
        found = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        strange = F.raise_error(F.concat(F.lit("a record of "), F.col("video_id"), F.lit(" lies under "), F.col("video")))
        return found.withColumn("video_id", F.when(F.col("video") == folder(), F.col("video_id")).otherwise(strange.cast("string")))

    def note(self, outcomes: DataFrame) -> None:
        """Adds records of outcomes (video_id, stage, input_hash, n_rows, failed). An empty hash fails the query."""
        made = record(outcomes).join(outcomes.select("video_id", "stage", "n_rows"), ["video_id", "stage"])
        made.withColumn("video", folder()).write.mode("append").partitionBy("video").parquet(f"{self.path}/manifest")

    def reset(self, videos: DataFrame) -> None:
        """All stages of videos (video_id) are to run again."""
        stages = F.explode(F.array(*map(F.lit, STAGES))).alias("stage")
        rows = videos.select("video_id", stages, F.lit("-").alias("input_hash"), F.lit(0).cast("long").alias("n_rows"), F.lit(True).alias("failed"))
        self.note(rows)

    def current(self, name: str) -> DataFrame | None:
        """The rows of a table that the manifest counts; null before there are any."""
        stage = next(s for s, tables in STAGES.items() if name in tables)
        if not self._exists(name):
            return None
        done = latest(self.manifest()).filter(F.col("stage") == stage).select("video_id", "input_hash")
        return self.spark.read.parquet(f"{self.path}/{name}").drop("video").join(done, ["video_id", "input_hash"], "left_semi")

    def todo(self, stage: str, inputs: DataFrame) -> DataFrame:
        """(video_id, input_hash) of inputs that have no done record of that hash, or have lost the table it tells of."""
        wanted = inputs.select("video_id", "input_hash", F.lit(stage).alias("stage"))
        manifest = self.manifest()
        new = pending(wanted, manifest)
        last = manifest.groupBy("video_id", "stage").agg(F.max_by(F.struct("input_hash", "status", "n_rows"), "finished").alias("r")).filter((F.col("stage") == stage) & (F.col("r.status") == "done") & (F.col("r.n_rows") > 0))
        lost = wanted.join(last.select("video_id", F.col("r.input_hash").alias("input_hash")), ["video_id", "input_hash"], "left_semi")
        if self._exists(table := STAGES[stage][0]):
            there = self.spark.read.parquet(f"{self.path}/{table}").select("video_id", "input_hash").distinct()
            lost = lost.join(there, ["video_id", "input_hash"], "left_anti")
        return new.union(lost.select(new.columns)).select("video_id", "input_hash").distinct()

    def work(self, stage: str, inputs: DataFrame, build: Callable[[DataFrame], list[DataFrame]], failed: Callable[[], DataFrame] | None = None) -> int:
        """Builds the tables of a stage for the inputs that need it and records them; the number of videos worked on.
        ``failed`` tells, from the tables written, the videos (video_id) whose record must not count as done."""
        todo = self.kept(self.todo(stage, inputs))
        n = todo.count()
        if n:
            for name, table in zip(STAGES[stage], build(todo), strict=True):
                made = table.join(todo, "video_id").withColumn("video", folder())
                made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video", "input_hash").parquet(f"{self.path}/{name}")
            first, counts = STAGES[stage][0], todo.withColumn("n_rows", F.lit(0).cast("long"))
            if self._exists(first):
                rows = self.spark.read.parquet(f"{self.path}/{first}").groupBy("video_id", "input_hash").agg(F.count(F.lit(1)).alias("n"))
                counts = todo.join(rows, ["video_id", "input_hash"], "left").select("video_id", "input_hash", F.coalesce("n", F.lit(0).cast("long")).alias("n_rows"))
            outcomes = counts.withColumn("stage", F.lit(stage)).withColumn("failed", F.lit(False))
            self.note(outcomes)
            if failed is not None:
                bad = outcomes.join(failed(), "video_id", "left_semi").withColumn("failed", F.lit(True))
                if not bad.isEmpty():
                    self.note(bad)
        self._forget()
        return n


def only(rows: DataFrame, todo: DataFrame) -> DataFrame:
    return rows.join(todo.select("video_id"), "video_id", "left_semi").drop("input_hash")


def decoded(raw: DataFrame) -> DataFrame:
    """Normalised lines of raw captions (video_id, raw, source), recognised speech in its own form."""
    spoken: Column = F.col("source") == "whisper"
    return normalize(decode_json3(raw.filter(~spoken)).unionByName(decode_asr(raw.filter(spoken))))


def run_all(spark: SparkSession, raw: DataFrame, path: str, client: ModelClient, settings: Settings = Settings(), force: bool = False, fast: bool = False, say: Callable[[str], None] = lambda line: None) -> DataFrame:
    """(video_id, confidence, failed_chunks, passes) of captions (video_id, raw, source) after all stages. Videos whose
    input, settings and tables are as recorded are skipped, stage by stage; ``force`` runs all stages again. A video of
    which every chunk failed is recorded as failed, so that it is asked about again next time. Ids that are no run names
    fail the query."""
    runs = Runs(spark, path)
    named = raw.withColumn("video_id", F.when(run_id_valid(F.col("video_id")), F.col("video_id")).otherwise(F.raise_error(F.concat(F.lit("no run name: "), F.col("video_id"))).cast("string")))
    videos = named.select("video_id").distinct()
    if force:
        runs.reset(videos)
    shape = SegmentConfig(max_tokens=settings["segment.max_tokens"], max_seconds=settings["segment.max_seconds"], pause_gap=settings["segment.pause_gap"])
    config = ExtractConfig(settings["models.fast" if fast else "models.primary"], workers=settings["extract.workers"], retries=settings["extract.retries"])

    def step(stage: str, inputs: DataFrame, build, failed=None) -> None:
        n = runs.work(stage, inputs, build, failed)
        say(f"{stage}: {n} videos" if n else f"{stage}: skipped (nothing has changed)")

    step("fetch", named.select("video_id", content_hash(F.concat_ws("/", "source", "raw")).alias("input_hash")), lambda todo: [decoded(only(named, todo))])
    lines = only(runs.current("transcript"), named)
    step("segment", rows_hash(videos, lines, ["ord", "start", "end", "text"], config_digest(shape)), lambda todo: [segment(only(lines, todo), shape)])
    chunks = only(runs.current("chunks"), named)
    asked = rows_hash(videos, chunks, ["chunk_id", "text"], config_digest(config))
    step("triage", asked, lambda todo: [triage(ask_verdicts(only(chunks, todo), client, config))])
    verdicts = only(runs.current("triage"), named)

    def edits(todo: DataFrame) -> list[DataFrame]:
        kept = only(chunks, todo).join(verdicts.filter("kept").select("video_id", "chunk_id"), ["video_id", "chunk_id"], "left_semi")
        told = deep_extract(context_before(kept, "video_id", "chunk_no"), client, config)
        told = runs.kept(told)  # a model is asked once
        failed = told.filter("error is not null").select("video_id", "chunk_id", "error")
        return [export_union(events_of(told).select("video_id", "chunk_id", "seq", "ord", "op", "file", "anchor", "code"), failed)]

    def hopeless() -> DataFrame:
        passed = verdicts.filter("kept").select("video_id", "chunk_id")
        failed = runs.current("events").filter("kind = 1").select("video_id", "chunk_id", F.lit(True).alias("f"))
        return all_failed(passed.join(failed, ["video_id", "chunk_id"], "left").select("video_id", F.coalesce("f", F.lit(False)).alias("failed")), "video_id")

    step("extract", rows_hash(videos, verdicts.join(asked, "video_id"), ["chunk_id", "kept", "input_hash"]), edits, hopeless)
    found = runs.current("events")
    log = only(found, named) if found is not None else spark.createDataFrame([], "video_id string, chunk_id string, seq int, ord int, op string, file string, anchor string, code string, kind int, error string")
    events = log.filter("kind = 0")

    def files_of(todo: DataFrame) -> list[DataFrame]:
        done = replay(only(events, todo))
        return [done.select("video_id", "file", "content"), replay_report(done)]

    step("assemble", rows_hash(videos, events, ["chunk_id", "seq", "ord", "op", "file", "anchor", "code"]), files_of)
    files = runs.current("files")
    if files is None:
        files = spark.createDataFrame([], "video_id string, file string, content string")
    files = only(files, named) if "input_hash" in files.columns else files

    def checks(todo: DataFrame) -> list[DataFrame]:
        own = only(files, todo)
        told = own.select("video_id", "file", metadata(F.col("content")).alias("metadata"))
        return [confidence(own).join(told, ["video_id", "file"]), findings(own)]

    step("verify", rows_hash(videos, files, ["file", "content"]), checks)
    scores = runs.current("report")
    scores = overall(only(scores, named)) if scores is not None else spark.createDataFrame([], "video_id string, confidence double")
    lost = log.filter("kind = 1").groupBy("video_id").agg(F.count(F.lit(1)).alias("failed_chunks"))
    summary = videos.join(scores, "video_id", "left").join(lost, "video_id", "left")
    score = F.coalesce("confidence", F.lit(0.0))  # no files: 0
    return summary.select("video_id", score.alias("confidence"), F.coalesce("failed_chunks", F.lit(0).cast("long")).alias("failed_chunks"), (score >= settings["verify.min_confidence"]).alias("passes"))


def assembly_report(records: DataFrame) -> DataFrame:
    """(video_id, applied, skipped, files, ops) of replay records, the operations in the order they were replayed in."""
    row = F.struct("chunk_id", "seq", "file", "op", "status", "detail")
    ops = F.array_sort(F.collect_list(row))
    return records.groupBy("video_id").agg(
        F.count_if(F.col("status") == "applied").alias("applied"), F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.array_sort(F.collect_set("file")).alias("files"), ops.alias("ops"),
    )


def verify_report(scores: DataFrame, found: DataFrame) -> DataFrame:
    """(video_id, files, findings, confidence) of scores (video_id, file, program_type, metadata, confidence) and findings."""
    files = scores.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("file", "program_type", F.to_json("metadata").alias("metadata"), "confidence"))).alias("files"), F.avg("confidence").alias("confidence"))
    said = found.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("file", "pos", "severity", "check", "detail"))).alias("findings"))
    return files.join(said, "video_id", "left").select("video_id", "files", "findings", "confidence")
