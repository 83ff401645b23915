"""Reading captions, event logs and assembled files; writing logs and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.functions.text import strip_space
from scriptloom.operators.events import first_error

JSON3 = "struct<events: array<struct<tStartMs: double, dDurationMs: double, segs: array<struct<utf8: string>>>>>"
ASR = "array<struct<start: double, end: double, text: string>>"
EVENT = "chunk_id string, seq int, op string, file string, anchor string, code string"


def decode_json3(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Timed lines of raw caption documents: (video_id, ord, start, end, text). Events without segments are skipped,
    missing numbers are 0, a malformed document fails the query."""
    doc = F.from_json(F.col(raw), JSON3, {"mode": "FAILFAST"})
    e = df.select("video_id", F.posexplode(doc["events"]).alias("ord", "e")).filter(F.size("e.segs") > 0)
    start, length = F.coalesce("e.tStartMs", F.lit(0.0)), F.coalesce("e.dDurationMs", F.lit(0.0))
    text = F.array_join(F.transform("e.segs", lambda s: s["utf8"]), "")
    return e.select("video_id", "ord", (start / 1000).alias("start"), (start / 1000 + length / 1000).alias("end"), text.alias("text"))


def decode_asr(df: DataFrame, raw: str = "raw") -> DataFrame:
    rows = df.select("video_id", F.posexplode(F.from_json(F.col(raw), ASR, {"mode": "FAILFAST"})).alias("ord", "e"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select("video_id", "ord", zero(F.col("e.start")).alias("start"), zero(F.col("e.end")).alias("end"), F.coalesce("e.text", F.lit("")).alias("text"))


def best_captions(manual: DataFrame, auto: DataFrame, asr: DataFrame, mode: str = "auto") -> DataFrame:
    """One source per video (video_id, raw, source): mode "captions" takes manual ones only, "whisper" speech
    recognition only, "auto" manual, then automatic, then recognised."""
    tagged = [f.select("video_id", "raw", F.lit(tag).alias("source"), F.lit(k).alias("k")) for k, (tag, f) in enumerate((("captions-manual", manual), ("captions-auto", auto), ("whisper", asr)))]
    wanted = {"captions": tagged[:1], "whisper": tagged[2:], "auto": tagged}[mode]
    union = wanted[0]
    for f in wanted[1:]:
        union = union.unionByName(f)
    return union.groupBy("video_id").agg(F.min_by(F.struct("raw", "source"), "k").alias("s")).select("video_id", "s.raw", "s.source")


def route_jsonl(lines: DataFrame, value: str = "value") -> DataFrame:
    """(kind, event fields, error) of log lines; blank and # lines are skipped. The key "error", even null, makes a
    failure marker; lines that are not JSON objects have kind "invalid"."""
    v = strip_space(F.col(value))
    rows = lines.filter((v != "") & ~v.startswith("#"))
    keys = F.json_object_keys(v)
    kind = F.when(keys.isNull(), "invalid").when(F.array_contains(keys, "error"), "failed").otherwise("event")
    return rows.select("*", kind.alias("kind"), F.from_json(v, f"{EVENT}, error string").alias("record"))


def log_reject(kind: Column, value: Column, record: Column) -> Column:
    """What is wrong with a log line of ``route_jsonl``, null for a good one: no JSON object, a field of another type, or
    the first rule that an event breaks. Absent and null fields count as empty."""
    doc = F.try_parse_json(value)
    kinds = {name: F.schema_of_variant(F.try_variant_get(doc, f"$.{name}", "variant")) for name in ("chunk_id", "seq", "op", "file", "anchor", "code", "error")}
    other = {name: found.isNotNull() & ~found.isin("VOID", "BIGINT" if name == "seq" else "STRING") for name, found in kinds.items()}
    wrong = lambda *names: F.coalesce(*(F.when(other[n], f"type of {n}") for n in names))
    rule = first_error(*(record[n] for n in ("chunk_id", "seq", "op", "file", "anchor", "code")))
    return F.when(kind == "invalid", "not a JSON object").when(kind == "failed", wrong("chunk_id", "error")).otherwise(F.coalesce(wrong("chunk_id", "seq", "op", "file", "anchor", "code"), rule))


def read_event_log(spark: SparkSession, path: str, quarantine: bool = False) -> DataFrame:
    """Events and failure markers of a log; a line with a ``log_reject`` fails the query unless ``quarantine`` keeps it
    aside as kind "invalid"."""
    routed = route_jsonl(spark.read.text(path))
    reject = log_reject(F.col("kind"), strip_space(F.col("value")), F.col("record"))
    bad = F.lit("invalid") if quarantine else F.raise_error(F.concat(F.lit("bad log line ("), reject, F.lit("): "), F.col("value")))
    return routed.withColumn("kind", F.when(reject.isNotNull(), bad).otherwise(F.col("kind"))).select("kind", "record.*")


def export_union(events: DataFrame, failed: DataFrame) -> DataFrame:
    """Events, then failure markers, in one table."""
    return events.withColumn("kind", F.lit(0)).unionByName(failed.withColumn("kind", F.lit(1)), allowMissingColumns=True)


def write_log(events: DataFrame, failed: DataFrame, path: str) -> None:
    export_union(events, failed).sort("kind", *(["video_id"] if "video_id" in events.columns else []), "chunk_id", "seq").drop("kind").write.mode("overwrite").json(path)


def read_outputs(spark: SparkSession, path: str, pattern: str = "*.mq5", cap: int = 16 << 20) -> DataFrame:
    """(file, content) of source files; a file beyond ``cap`` bytes fails the query."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    small = F.when(F.col("length") > cap, F.raise_error(F.concat(F.lit("too large: "), F.col("path")))).otherwise(F.col("content"))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), small.cast("string").alias("content"))


LINES = "start double, end double, text string"
CHUNKS = "id string, start double, end double, text string"


def read_array(spark: SparkSession, path: str, schema: str, cap: int = 64 << 20) -> DataFrame:
    """(video_id, ord and the fields of ``schema``) of JSON files with one array each, the id being the file's name up to
    its first full stop; null is an empty array. A file beyond ``cap`` bytes or of another shape fails the query."""
    files = spark.read.format("binaryFile").load(path)
    text = F.when(F.col("length") > cap, F.raise_error(F.concat(F.lit("too large: "), F.col("path"))).cast("string")).otherwise(F.col("content").cast("string"))
    rows = F.from_json(F.nullif(strip_space(text), F.lit("null")), f"array<struct<{', '.join(': '.join(f.split()) for f in schema.split(', '))}>>", {"mode": "FAILFAST"})
    name = F.element_at(F.split(F.element_at(F.split("path", "/"), -1), r"\."), 1)
    return files.select(name.alias("video_id"), F.posexplode(rows).alias("ord", "r")).select("video_id", "ord", "r.*")


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Reports as ``write.json`` has put them; a line of another shape fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_files(files: DataFrame, path: str) -> None:
    """One text table per (video_id, file), committed atomically; only the partitions written are replaced."""
    files.select("video_id", "file", F.col("content").alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_id", "file").option("lineSep", "\0").text(path)


def json_int(value: Column, key: str) -> Column:
    return F.coalesce(F.get_json_object(value, f"$.{key}").cast("int"), F.lit(0))
