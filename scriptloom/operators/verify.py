"""Static checks of assembled files (video_id, file, content) and their score."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.functions.text import bind, snippet, strip_space

# Comments, strings and character literals; possessive, so that long ones need no stack.
NOISE = r"""//[^\n]*|/\*(?:[^*]|\*(?!/))*+(?:\*/|\z)|"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+(?:"|\\?\z)|'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+(?:'|\\?\z)"""
# Marks of unfinished code, with what a finding says. Words end where ASCII letters, digits and _ do.
ARTIFACTS = [
    (r"(?<![A-Za-z0-9_])TODO(?![A-Za-z0-9_])", "TODO marker left in code"),
    (r"(?<![A-Za-z0-9_])FIXME(?![A-Za-z0-9_])", "FIXME marker left in code"),
    (r"(?i)(?<![A-Za-z0-9_])placeholder(?![A-Za-z0-9_])", "placeholder text"),
    (r"<[^>]*your[^>]*>", "template placeholder like <your...>"),
    (r"\.\.\.\s*\z", "ellipsis at end of line (possible truncation)"),
]
# Penalties of findings.
ERROR, WARNING = 0.25, 0.05


def program_type(source: Column) -> Column:
    return F.when(F.contains(source, F.lit("OnCalculate")), "indicator").when(F.contains(source, F.lit("OnStart")), "script").when(F.contains(source, F.lit("OnInit")) | F.contains(source, F.lit("OnTick")), "ea").otherwise("unknown")


def missing_entry_points(source: Column) -> Column:
    """Required functions that the text, comments included, does not name."""
    wanted = F.when(program_type(source) == "ea", F.array(F.lit("OnInit"), F.lit("OnTick"))).otherwise(F.array().cast("array<string>"))
    return F.filter(wanted, lambda f: ~F.contains(source, f))


def strip_code(source: Column) -> Column:
    return F.regexp_replace(source, NOISE, "")


def balanced(code: Column, opening: str, closing: str) -> Column:
    """Depth never falls below 0 and ends at 0."""
    marks = F.split(F.regexp_replace(code, rf"[^\{opening}\{closing}]", ""), "")
    step = lambda s, c: F.struct(
        (s["d"] + F.when(c == opening, 1).when(c == closing, -1).otherwise(0)).alias("d"),
        (s["ok"] & ~((c == closing) & (s["d"] < 1))).alias("ok"),
    )
    return F.aggregate(marks, F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok")), step, lambda s: s["ok"] & (s["d"] == 0))


def has_strict(source: Column) -> Column:
    return F.contains(source, F.lit("#property strict"))


def code_lines(source: Column) -> Column:
    """The lines without white space at their ends that are neither blank nor a // comment."""
    return F.filter(F.transform(F.split(source, "\n"), strip_space), lambda x: (x != "") & ~x.startswith("//"))


def artifact_lines(source: Column) -> Column:
    """(line, mark) for each trimmed line that is neither blank nor a // comment and holds a mark as a word."""
    marks = lambda x: F.array(*[F.when(x.rlike(p), F.struct(x.alias("line"), F.lit(says).alias("mark"))) for p, says in ARTIFACTS])
    return F.filter(F.flatten(F.transform(code_lines(source), marks)), lambda m: m.isNotNull())


def truncated(source: Column) -> Column:
    """The last line that is neither blank nor a // comment does not end a statement."""
    last = F.try_element_at(code_lines(source), F.lit(-1))
    return F.coalesce(~last.rlike(r"(;|\{|\}|\*/)\z"), F.lit(False))


def metadata(source: Column) -> Column:
    """Properties by lower-cased key, the first of each. The key's white space may cross a line end, and comments are
    cut without regard to strings, as parity asks."""
    text = F.regexp_replace(F.regexp_replace(source, r"/\*(?:[^*]|\*(?!/))*+(?:\*/|\z)", ""), r"//[^\n]*", "")
    pattern = r'(?dm)^\s*#property\s+([A-Za-z_]+)\s+"?([^"\r\n]*)"?'
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda k, v: F.struct(F.lower(k).alias("k"), strip_space(v).alias("v")))
    return F.map_from_entries(F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda p: p["k"] == e["k"])))


def checks_of(src: Column) -> Column:
    """Findings (severity, check, detail) of a file in the order of the checks."""
    return bind(strip_code(src), lambda code: _checks(src, code))


def _checks(src: Column, code: Column) -> Column:
    one = lambda severity, check, detail: F.array(F.struct(F.lit(severity).alias("severity"), F.lit(check).alias("check"), F.lit(detail).alias("detail")))
    none = F.array().cast("array<struct<severity: string, check: string, detail: string>>")
    named = lambda array, severity, check, detail: F.transform(array, lambda x: F.struct(F.lit(severity).alias("severity"), F.lit(check).alias("check"), detail(x).alias("detail")))
    return F.concat(
        F.when(~balanced(code, "{", "}"), one("error", "balance", "unbalanced {}")).otherwise(none),
        F.when(~balanced(code, "(", ")"), one("error", "balance", "unbalanced ()")).otherwise(none),
        named(missing_entry_points(src), "error", "entry_points", lambda x: F.concat(F.lit("missing "), x)),
        F.when(~has_strict(src), one("warning", "property_strict", "missing #property strict")).otherwise(none),
        named(artifact_lines(src), "warning", "artifacts", lambda x: F.concat(x["mark"], F.lit(": "), snippet(x["line"], 80))),
        F.when(truncated(src), one("warning", "truncation", "last line ends no statement")).otherwise(none),
    )


def findings(files: DataFrame) -> DataFrame:
    """(video_id, file, pos, severity, check, detail) in the order of the checks."""
    return files.select("video_id", "file", F.posexplode(checks_of(F.col("content"))).alias("pos", "f")).select("video_id", "file", "pos", "f.*")


def confidence(files: DataFrame) -> DataFrame:
    """(video_id, file, program_type, confidence): 1 less each penalty in turn, 0 at least. The subtraction is stepwise,
    as sums of many small doubles differ from their closed form at the threshold."""
    cost = lambda f: F.when(f["severity"] == "error", F.lit(ERROR)).otherwise(F.lit(WARNING))
    found = F.coalesce(checks_of(F.col("content")), F.array().cast("array<struct<severity: string, check: string, detail: string>>"))
    score = F.greatest(F.lit(0.0), F.aggregate(found, F.lit(1.0), lambda a, f: a - cost(f)))
    return files.select("video_id", "file", program_type(F.col("content")).alias("program_type"), score.alias("confidence"))


def ask_match(files: DataFrame, events: DataFrame, client, workers: int = 2) -> DataFrame:
    """(video_id, file, match, detail): whether a model finds that a file reflects its events' code and nothing else.
    Files without events are not asked about; a failed call fails the query."""
    order = F.struct("chunk_id", "seq", "ord", "code")
    code = events.groupBy("video_id", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda e: F.concat(F.coalesce(e["code"], F.lit("")), F.lit("\n"))), "").alias("code"))
    head = F.lit("Does the file hold exactly the code of the events? Answer as JSON: match, missing, extra, notes.\nFile:\n")
    asked = files.join(code, ["video_id", "file"]).select("video_id", "file", F.concat(head, F.col("content"), F.lit("\nEvents:\n"), F.col("code")).alias("prompt"))

    def run(frames):
        for frame in frames:
            replies = [json.loads(client.chat(p, 512)) for p in frame["prompt"]]
            said = [[f"{k}: {' | '.join(v) if isinstance(v, list) else v}" for k in ("missing", "extra", "notes") if (v := r.get(k))] for r in replies]
            yield frame[["video_id", "file"]].assign(match=[bool(r["match"]) for r in replies], detail=["; ".join(["mismatch", *s]) for s in said])

    return asked.repartition(workers).mapInPandas(run, "video_id string, file string, match boolean, detail string")


def with_model_check(scores: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Scores (video_id, file, ..., confidence) less one error's penalty, 0 at least, where the model finds a mismatch."""
    wrong = verdicts.filter("not match").select("video_id", "file", F.lit(ERROR).alias("cost"))
    less = F.greatest(F.lit(0.0), F.col("confidence") - F.coalesce("cost", F.lit(0.0)))
    return scores.join(wrong, ["video_id", "file"], "left").withColumn("confidence", less).drop("cost")


def gate(scores: DataFrame, least: float = 0.6) -> DataFrame:
    """The scores below the least one that passes."""
    return scores.filter(F.col("confidence") < least)


def overall(scores: DataFrame) -> DataFrame:
    return scores.groupBy("video_id").agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"))
