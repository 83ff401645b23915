"""``python -m scriptloom pipeline | fetch | segment | extract | assemble | verify | fidelity``: the whole flow, or its stages over
files, of one or many videos.

Exit codes: 0 done, 1 a score below its limit, nothing extracted or no captions, 2 wrong arguments or settings.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.operators.extract import ExtractConfig, all_failed, ask_verdicts, context_before, deep_extract, triage
from scriptloom.operators.fidelity import compare
from scriptloom.operators.replay import replay, replay_report
from scriptloom.operators.segment import SegmentConfig, segment
from scriptloom.operators.transcript import normalize
from scriptloom.operators.verify import confidence, findings, gate, metadata
from scriptloom.plans.config import Settings, load
from scriptloom.plans.flow import events_of
from scriptloom.plans.runs import assembly_report, run_all, verify_report
from scriptloom.sources.captions import decode_json3, read_event_log, read_outputs, write_files, write_log
from scriptloom.sources.client import HttpClient
from scriptloom.sources.fetch import fetch

# Fixed value: the F1 that the worst file must reach.
FIDELITY = 0.95


def named(df: DataFrame) -> DataFrame:
    """Raw documents (video_id, raw), the id being the file's name up to its first full stop."""
    name = F.element_at(F.split("path", "/"), -1)
    return df.select(F.element_at(F.split(name, r"\."), 1).alias("video_id"), F.col("content").cast("string").alias("raw"))


def client_of(args, settings: Settings) -> HttpClient:
    model = settings["models.fast" if args.fast else "models.primary"]
    return HttpClient(settings["ollama.url"], model, settings["ollama.num_ctx"], settings["ollama.keep_alive"])


def run_pipeline(spark: SparkSession, args, settings: Settings) -> int:
    raw = named(spark.read.format("binaryFile").load(args.captions)).withColumn("source", F.lit(args.source))
    done = run_all(spark, raw, args.runs, client_of(args, settings), settings, args.force, args.fast, lambda line: print(line, file=sys.stderr))
    done.sort("video_id").write.mode("overwrite").json(f"{args.runs}/summary")
    r = spark.read.schema(done.schema).json(f"{args.runs}/summary").agg(F.count(F.lit(1)).alias("n"), F.sum("failed_chunks").alias("failed"), F.count_if(~F.col("passes")).alias("below")).first()
    print(f"{r['n']} videos, {r['failed'] or 0} failed chunks, {r['below']} videos below the least confidence")
    return int(r["below"] > 0)


def run_fetch(spark: SparkSession, args, settings: Settings) -> int:
    fetch(spark.read.text(args.urls).select(F.col("value").alias("url")), args.mode or "auto", workers=settings["extract.workers"]).write.mode("overwrite").parquet(args.out)
    failed = spark.read.parquet(args.out).filter("error is not null")
    for r in failed.limit(20).collect():  # a report: the first few
        print(f"{r['url']}: {r['error']}", file=sys.stderr)
    return int(not failed.isEmpty())


def run_extract(spark: SparkSession, args, settings: Settings) -> int:
    chunks, client = spark.read.json(args.chunks), client_of(args, settings)
    config = ExtractConfig(client.model, workers=settings["extract.workers"], retries=settings["extract.retries"])
    triage(ask_verdicts(chunks, client, config)).write.mode("overwrite").json(f"{args.out}/triage")
    kept = spark.read.schema("video_id string, chunk_id string, kept boolean").json(f"{args.out}/triage").filter("kept")
    passed = chunks.join(kept, ["video_id", "chunk_id"], "left_semi")
    deep_extract(context_before(passed, "video_id", "chunk_no"), client, config).write.mode("overwrite").parquet(f"{args.out}/replies")
    told = spark.read.parquet(f"{args.out}/replies")
    events = events_of(told).select("video_id", "chunk_id", "seq", "op", "file", "anchor", "code")
    write_log(events, told.filter("error is not null").select("video_id", "chunk_id", "error"), f"{args.out}/events")
    hopeless = all_failed(told.select("video_id", F.col("error").isNotNull().alias("failed")), "video_id")
    for r in hopeless.limit(20).collect():  # a report: the first few
        print(f"{r['video_id']}: every chunk failed", file=sys.stderr)
    return int(not hopeless.isEmpty())


def run_segment(spark: SparkSession, args, settings: Settings) -> int:
    raw = named(spark.read.format("binaryFile").load(args.captions))
    shape = SegmentConfig(max_tokens=settings["segment.max_tokens"], max_seconds=settings["segment.max_seconds"], pause_gap=settings["segment.pause_gap"])
    segment(normalize(decode_json3(raw)), shape).write.mode("overwrite").json(args.out)
    return 0


def run_assemble(spark: SparkSession, args, settings: Settings) -> int:
    events = read_event_log(spark, args.events).filter("kind = 'event'").withColumn("video_id", F.lit(args.video)).withColumn("ord", F.monotonically_increasing_id())
    done = replay(events)
    write_files(done.select("video_id", "file", "content"), args.out)
    if args.report:
        assembly_report(replay_report(done)).write.mode("overwrite").json(args.report)
    return 0


def run_verify(spark: SparkSession, args, settings: Settings) -> int:
    files = read_outputs(spark, args.files).withColumn("video_id", F.lit(""))
    scores = confidence(files)
    if args.out:
        verify_report(scores.join(files.select("file", metadata(F.col("content")).alias("metadata")), "file"), findings(files)).write.mode("overwrite").json(args.out)
    mean = scores.agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"))
    print(f"confidence {mean.first()['confidence']:.3f}")
    return int(not gate(mean, settings["verify.min_confidence"]).isEmpty())


def run_fidelity(spark: SparkSession, args, settings: Settings) -> int:
    golden = read_outputs(spark, args.golden, "*").select(F.col("content").alias("golden"))
    if (given := golden.limit(2).count()) != 1:
        print("one golden file is needed" if given else "no golden file", file=sys.stderr)
        return 2
    # one golden file stands against every output: a table of one row
    pairs = read_outputs(spark, args.files).join(F.broadcast(golden), F.lit(True)).select(F.col("file").alias("pair_id"), "golden", F.col("content").alias("output"))
    worst = compare(pairs).agg(F.min_by(F.struct("pair_id", "f1"), F.struct("f1", "pair_id")).alias("w")).first()["w"]
    if worst is None:
        print("no files", file=sys.stderr)
        return 1
    print(f"worst {worst['pair_id']}: F1 {worst['f1']:.3f}")
    return int(worst["f1"] < FIDELITY)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = argparse.ArgumentParser(prog="scriptloom")
    top.add_argument("--config")
    top.add_argument("--min-confidence", type=float)
    stages = top.add_subparsers(dest="stage", required=True)
    for name, wanted, optional, f in (
        ("pipeline", ("captions", "runs"), (), run_pipeline),
        ("fetch", ("urls", "out"), ("mode",), run_fetch),
        ("segment", ("captions", "out"), (), run_segment),
        ("extract", ("chunks", "out"), (), run_extract),
        ("assemble", ("events", "out"), ("video", "report"), run_assemble),
        ("verify", ("files",), ("out",), run_verify),
        ("fidelity", ("golden", "files"), (), run_fidelity),
    ):
        p = stages.add_parser(name)
        p.set_defaults(f=f)
        for a in wanted:
            p.add_argument(f"--{a}", required=True)
        for a in optional:
            p.add_argument(f"--{a}", default="")
        if name in ("pipeline", "extract"):
            p.add_argument("--fast", action="store_true")
            p.add_argument("--workers", type=int)
        if name == "pipeline":
            p.add_argument("--force", action="store_true")
            p.add_argument("--source", default="captions-manual", choices=("captions-manual", "captions-auto", "whisper"))
    try:
        args = top.parse_args(argv)
        settings = load(args.config).override(verify__min_confidence=args.min_confidence, extract__workers=getattr(args, "workers", None))
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 2
    return args.f(spark or SparkSession.builder.appName("scriptloom").getOrCreate(), args, settings)


if __name__ == "__main__":
    sys.exit(main())
