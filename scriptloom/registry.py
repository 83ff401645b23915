"""Every query of the reference's operators over the driver's tables, with its DuckDB counterpart where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.functions import text as T
from scriptloom.operators import events as ev
from scriptloom.operators import extract as ex
from scriptloom.operators import fidelity as fi
from scriptloom.operators import verify as ve
from scriptloom.operators.neighbours import shifted
from scriptloom.operators.replay import replay, replay_report
from scriptloom.operators.segment import SegmentConfig, hard_groups, segment
from scriptloom.operators.transcript import clamp_overlap, normalize
from scriptloom.plans.manifest import pending
from scriptloom.sources.captions import export_union, json_int, route_jsonl

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def said(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as timed lines: a turn begins every 10 seconds and lasts 9."""
    t = read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("video_id"), F.col("turn").alias("ord"), F.coalesce("text", F.lit("")).alias("text"))
    return t.withColumn("start", F.col("ord") * 10.0).withColumn("end", F.col("start") + 9.0)


def timed_events(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return read(spark, d, "events").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("ord"), at.alias("start"), (at + F.col("value") * 100).alias("end"))


SPACES = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(f"""SELECT doc_id, t AS text FROM (SELECT doc_id, trim(regexp_replace(text, '{SPACES}', ' ', 'g')) AS t FROM documents) WHERE t <> ''""")
def norm_ws(spark, d):
    return read(spark, d, "documents").select("doc_id", T.collapse_space(F.col("text")).alias("text")).filter("text <> ''")


@query("""SELECT user_id AS video_id, event_id AS ord, s AS start, CASE WHEN n IS NULL THEN e ELSE greatest(s, least(e, n)) END AS "end"
FROM (SELECT *, lead(s) OVER (PARTITION BY user_id ORDER BY s, event_id) AS n FROM (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + value * 100 AS e FROM events))""")
def clamp_overlap_lines(spark, d):
    return clamp_overlap(timed_events(spark, d))


@query("SELECT doc_id, CAST((strlen(text) + 3) // 4 AS INTEGER) AS tokens FROM documents")
def token_est(spark, d):
    return read(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


COMMON = ["the", "and", "on", "er"]


@query("""SELECT conv_id, turn, starts_with(h, 'the') OR starts_with(h, 'and') OR starts_with(h, 'on') OR starts_with(h, 'er') AS cue
FROM (SELECT conv_id, turn, regexp_replace(trim(lower(text)), '^["''—(\\[ -]+', '') AS h FROM conversations)""")
def cue_flag(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", T.starts_with_cue(F.col("text"), COMMON).alias("cue"))


@query("""SELECT event_id AS ord, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY s, event_id) AS BIGINT) AS hard_group
FROM (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY user_id ORDER BY s, event_id) > 21600 THEN 1 ELSE 0 END AS f
FROM (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + value * 100 AS e FROM events))""")
def gap_sessions(spark, d):
    lines = timed_events(spark, d).withColumn("text", F.lit(""))
    return hard_groups(lines, SegmentConfig(pause_gap=21600, cues=())).select("ord", "hard_group")


SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CUE_SQL = " OR ".join("starts_with(h, '" + c.replace("'", "''") + "')" for c in T.CUES)


@query(rf"""WITH RECURSIVE t AS (SELECT CAST(conv_id AS VARCHAR) AS video_id, turn AS ord, turn * 10.0::DOUBLE AS s, turn * 10.0::DOUBLE + 9 AS e,
  trim(regexp_replace(coalesce(text, ''), '{SPACES}', ' ', 'g')) AS text FROM conversations),
l AS (SELECT *, lead(s) OVER w AS n, row_number() OVER w AS k, count(*) OVER (PARTITION BY video_id) AS total FROM t WHERE text <> '' WINDOW w AS (PARTITION BY video_id ORDER BY s, ord)),
c AS (SELECT video_id, k, total, s, text, CASE WHEN n IS NULL THEN e ELSE greatest(s, least(e, n)) END AS e, CAST((strlen(text) + 3) // 4 AS INTEGER) AS tokens,
  regexp_matches(regexp_replace(text, '["''’)\] ]+$', ''), '[.!?]$') AS stop, regexp_replace(lower(text), '^["''—(\[ -]+', '') AS h FROM l),
g AS (SELECT *, coalesce(s - lag(e) OVER (PARTITION BY video_id ORDER BY k) > 1.5, FALSE) OR {CUE_SQL} AS hard, struct_pack(s := s, e := e, text := text, tokens := tokens, stop := stop) AS line FROM c),
f AS (SELECT video_id, k, total, [line] AS cur, CAST(NULL AS STRUCT(s DOUBLE, e DOUBLE, "text" VARCHAR, tokens INTEGER, stop BOOLEAN)[]) AS done FROM g WHERE k = 1
  UNION ALL SELECT video_id, k, total, CASE WHEN hard THEN [line] WHEN is_full THEN list_append(cur[cut + 1:], line) ELSE list_append(cur, line) END, CASE WHEN hard THEN cur WHEN is_full THEN cur[:cut] END
  FROM (SELECT g.video_id, g.k, g.total, g.hard, g.line, f.cur, list_sum(list_transform(f.cur, lambda x: x.tokens)) + g.tokens > 350 OR g.e - f.cur[1].s > 45 AS is_full,
    coalesce(list_max(list_filter(list_transform(f.cur, lambda x, i: CASE WHEN i > 1 AND x.stop THEN i END), lambda i: i IS NOT NULL)), len(f.cur)) AS cut FROM f JOIN g ON g.video_id = f.video_id AND g.k = f.k + 1)),
a AS (SELECT video_id, k, done AS c FROM f WHERE done IS NOT NULL UNION ALL SELECT video_id, k + 1, cur FROM f WHERE k = total),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY video_id ORDER BY k) AS INTEGER) AS chunk_no FROM a)
SELECT video_id, printf('c%04d', chunk_no) AS chunk_id, chunk_no, c[1].s AS start, c[-1].e AS "end", list_aggregate(list_transform(c, lambda x: x.text), 'string_agg', ' ') AS text,
  CAST(len(c) AS INTEGER) AS n_lines, CAST(list_sum(list_transform(c, lambda x: x.tokens)) AS INTEGER) AS tokens FROM n""")
def cap_chunks(spark, d):
    return segment(normalize(said(spark, d)))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(spark, d):
    return read(spark, d, "events").select("event_id", json_int(F.col("props"), "k").alias("k"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'failed' WHEN doc_id % 3 = 1 THEN 'event' ELSE 'invalid' END AS kind FROM documents""")
def jsonl_router(spark, d):
    docs = read(spark, d, "documents")
    good = F.to_json(F.struct(F.col("source").alias("chunk_id"), F.lit(1).alias("seq"), F.col("lang").alias("file")))
    bad = F.to_json(F.struct(F.col("source").alias("chunk_id"), F.lit(None).cast("string").alias("error")), {"ignoreNullFields": "false"})
    value = F.when(F.col("doc_id") % 3 == 0, bad).when(F.col("doc_id") % 3 == 1, good).otherwise("{broken")
    return route_jsonl(docs.select("doc_id", value.alias("value"))).select("doc_id", "kind")


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN TRUE ELSE l.quality = 1 END AS kept FROM documents d LEFT JOIN labels l USING (doc_id)""")
def triage_fail_open(spark, d):
    joined = read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    verdicts = joined.select("doc_id", (F.col("quality") == 1).alias("has_code_action"), F.lit(1.0).alias("confidence"), F.when(F.col("quality").isNull(), "no verdict").alias("error"))
    return ex.triage(verdicts).select("doc_id", "kept")


@query("""SELECT doc_id, coalesce(lag(right(text, 200)) OVER (PARTITION BY source ORDER BY doc_id), '') AS context FROM documents""")
def context_before(spark, d):
    return ex.context_before(read(spark, d, "documents").select("doc_id", "source", "text"), "source", "doc_id").select("doc_id", "context")


@query("""SELECT n_chars, count(*) AS passed, CAST(sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS BIGINT) AS failures
FROM documents JOIN labels USING (doc_id) WHERE toxic = 0 GROUP BY n_chars HAVING count(*) = sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END)""")
def all_failed(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "n_chars").join(read(spark, d, "labels"), "doc_id").filter("toxic = 0")
    return ex.all_failed(rows.select("n_chars", (F.col("quality") == 0).alias("failed")), "n_chars")


def seeded_events(spark, d) -> DataFrame:
    """Conversations as edit events of one file each, some of them defective."""
    t = read(spark, d, "conversations")
    turn = F.col("turn")
    op = F.when(turn == 0, "create").when(turn % 4 == 1, "append").when(turn % 4 == 2, "replace").when(turn % 4 == 3, "property").otherwise("delete")
    return t.select(
        F.col("conv_id").cast("string").alias("video_id"), F.format_string("c%04d", (turn / 2).cast("int") + 1).alias("chunk_id"), turn.alias("ord"), (turn % 2).cast("int").alias("pos"),
        F.when(turn % 2 == 1, F.lit(None)).otherwise(turn).cast("int").alias("seq"), op.alias("op"), F.when(F.col("conv_id") % 5 == 0, F.lit("a/b.mq5")).otherwise(F.concat(F.lit("f"), F.col("conv_id").cast("string"), F.lit(".mq5"))).alias("file"),
        F.when(turn % 4 == 2, F.left("text", F.lit(5))).alias("anchor"), F.col("text").alias("code"),
    )


SEEDED = """SELECT CAST(conv_id AS VARCHAR) AS video_id, 'c' || lpad(CAST(turn // 2 + 1 AS VARCHAR), 4, '0') AS chunk_id, turn AS ord, turn % 2 AS pos,
CASE WHEN turn % 2 = 1 THEN NULL ELSE turn END AS seq,
CASE WHEN turn = 0 THEN 'create' WHEN turn % 4 = 1 THEN 'append' WHEN turn % 4 = 2 THEN 'replace' WHEN turn % 4 = 3 THEN 'property' ELSE 'delete' END AS op,
CASE WHEN conv_id % 5 = 0 THEN 'a/b.mq5' ELSE 'f' || conv_id || '.mq5' END AS file, CASE WHEN turn % 4 = 2 THEN left(text, 5) END AS anchor, text AS code FROM conversations"""
RULES = """CASE WHEN {seq} IS NULL OR {seq} < 1 THEN 'seq' WHEN op = 'delete' THEN 'op' WHEN file LIKE '%/%' THEN 'bare name'
WHEN op = 'replace' AND trim(coalesce(anchor, '')) = '' THEN 'anchor' WHEN op <> 'replace' AND coalesce(code, '') = '' THEN 'code' END"""


@query(f"SELECT video_id, ord, {RULES.format(seq='seq')} AS reject FROM ({SEEDED})")
def event_validate(spark, d):
    return ev.validate(seeded_events(spark, d)).select("video_id", "ord", "reject")


@query(f"""SELECT video_id, ord, CAST(s AS INTEGER) AS seq, bool_and(reject IS NULL) OVER (PARTITION BY video_id, chunk_id) AS chunk_ok
FROM (SELECT *, {RULES.format(seq='s')} AS reject FROM (SELECT *, CASE WHEN coalesce(seq, 0) < 1 THEN pos + 1 ELSE seq END AS s FROM ({SEEDED})))""")
def event_reanchor(spark, d):
    return ev.reanchor(seeded_events(spark, d)).select("video_id", "ord", "seq", "chunk_ok")


def replayable(spark, d) -> DataFrame:
    return seeded_events(spark, d).withColumn("seq", F.col("pos") + 1)


REPLAYED = rf"""WITH RECURSIVE e AS (SELECT video_id, file, op, coalesce(code, '') AS code, coalesce(anchor, '') AS anchor,
  row_number() OVER (PARTITION BY video_id, file ORDER BY chunk_id, pos + 1, ord) AS k, count(*) OVER (PARTITION BY video_id, file) AS total FROM ({SEEDED})),
f AS (SELECT DISTINCT video_id, file, 0::BIGINT AS k, total, FALSE AS made, '' AS content, CAST(NULL AS VARCHAR) AS op, CAST(NULL AS VARCHAR) AS status FROM e
  UNION ALL SELECT video_id, file, k, total, made OR (ok AND op <> 'replace'),
    CASE WHEN NOT ok THEN content WHEN op = 'create' THEN ended WHEN op = 'append' THEN broken || ended WHEN op = 'replace' THEN replace(content, anchor, code)
      WHEN contains(content, line || chr(10)) OR (ends_with(content, line) AND NOT contains(line, chr(10))) THEN content
      ELSE head || CASE WHEN head = '' OR ends_with(head, chr(10)) THEN '' ELSE chr(10) END || line || chr(10) || substr(content, length(head) + 1) END,
    op, CASE WHEN ok THEN 'applied' ELSE 'skipped' END
  FROM (SELECT e.*, f.made, f.content, trim(e.code, chr(10)) || chr(10) AS ended, rtrim(e.code, chr(10)) AS line,
      CASE WHEN f.content = '' OR ends_with(f.content, chr(10)) THEN f.content ELSE f.content || chr(10) END AS broken,
      regexp_extract(f.content, '^(?:[ \t\r]*(?:(?://|/\*|#property|#include|#pragma)[^\n]*)?(?:\n|\z))*') AS head,
      CASE WHEN e.op = 'create' THEN NOT f.made WHEN e.op = 'replace' THEN f.made AND e.anchor <> '' AND length(f.content) - length(replace(f.content, e.anchor, '')) = length(e.anchor) ELSE e.op IN ('append', 'property', 'include') END AS ok
    FROM f JOIN e ON e.video_id = f.video_id AND e.file = f.file AND e.k = f.k + 1))
"""


@query(REPLAYED + "SELECT video_id, file, content FROM f WHERE k = total")
def replay_files(spark, d):
    return replay(replayable(spark, d)).select("video_id", "file", "content")


@query(REPLAYED + "SELECT op, status, count(*) AS n FROM f WHERE k > 0 GROUP BY op, status")
def replay_status(spark, d):
    return replay_report(replay(replayable(spark, d))).groupBy("op", "status").agg(F.count(F.lit(1)).alias("n"))


def sources(spark, d) -> DataFrame:
    """Documents as source files: a head by doc_id mod 4, a mark of unfinished work by doc_id mod 7."""
    k = F.col("doc_id") % 4
    head = F.when(k == 0, "#property strict\nint OnInit() {\n").when(k == 1, "void OnTick() {\n").when(k == 2, "#property strict\nvoid OnStart() {\n").otherwise("#property copyright \"me\"\n{\n")
    tail = F.when(F.col("doc_id") % 7 == 0, "\nx = 1; // TODO\n}\n").otherwise("\n}\n")
    return read(spark, d, "documents").select(F.col("source").alias("video_id"), F.col("doc_id").cast("string").alias("file"), F.concat(head, F.coalesce("text", F.lit("")), tail).alias("content"))


SOURCES = """SELECT source AS video_id, CAST(doc_id AS VARCHAR) AS file, CASE doc_id % 4 WHEN 0 THEN '#property strict' || chr(10) || 'int OnInit() {' || chr(10)
WHEN 1 THEN 'void OnTick() {' || chr(10) WHEN 2 THEN '#property strict' || chr(10) || 'void OnStart() {' || chr(10) ELSE '#property copyright "me"' || chr(10) || '{' || chr(10) END
|| coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN chr(10) || 'x = 1; // TODO' || chr(10) || '}' || chr(10) ELSE chr(10) || '}' || chr(10) END AS content FROM documents"""


@query(f"""SELECT file, CASE WHEN contains(content, 'OnCalculate') THEN 'indicator' WHEN contains(content, 'OnStart') THEN 'script'
WHEN contains(content, 'OnInit') OR contains(content, 'OnTick') THEN 'ea' ELSE 'unknown' END AS program_type,
CASE WHEN contains(content, 'OnCalculate') OR contains(content, 'OnStart') OR NOT (contains(content, 'OnInit') OR contains(content, 'OnTick')) THEN 0
ELSE CAST(NOT contains(content, 'OnInit') AS INTEGER) + CAST(NOT contains(content, 'OnTick') AS INTEGER) END AS missing FROM ({SOURCES})""")
def program_type(spark, d):
    src = F.col("content")
    return sources(spark, d).select("file", ve.program_type(src).alias("program_type"), F.size(ve.missing_entry_points(src)).alias("missing"))


CODE_SQL = r"""regexp_replace({}, '//[^\n]*|/\*[\s\S]*?(?:\*/|\z)|"[^"\\]*(?:\\[\s\S][^"\\]*)*(?:"|\\?\z)|''[^''\\]*(?:\\[\s\S][^''\\]*)*(?:''|\\?\z)', '', 'g')"""


@query(f"""SELECT page_id, sha256({CODE_SQL.format("html")}) AS code_sha256 FROM pages""")
def strip_code(spark, d):
    return read(spark, d, "pages").select("page_id", F.sha2(ve.strip_code(F.col("html")), 256).alias("code_sha256"))


@query("""SELECT page_id, strlen(s) - strlen(replace(s, '{', '')) = strlen(s) - strlen(replace(s, '}', '')) AND list_min(list_transform(list_append(range(1, len(m) + 1), 0), lambda i: CASE WHEN i = 0 THEN 0 ELSE
strlen(replace(left(m, i), '}', '')) - strlen(replace(left(m, i), '{', '')) END)) >= 0 AS ok
FROM (SELECT page_id, html AS s, regexp_replace(html, '[^{}]', '', 'g') AS m FROM pages)""")
def balance(spark, d):
    return read(spark, d, "pages").select("page_id", ve.balanced(F.col("html"), "{", "}").alias("ok"))


@query(f"""SELECT file, CAST(sum(CAST(regexp_matches(l, '\\bTODO\\b') AS INTEGER) + CAST(regexp_matches(l, '\\bFIXME\\b') AS INTEGER) + CAST(regexp_matches(l, '(?i)\\bplaceholder\\b') AS INTEGER)
+ CAST(regexp_matches(l, '<[^>]*your[^>]*>') AS INTEGER) + CAST(regexp_matches(l, '\\.\\.\\.\\s*$') AS INTEGER)) AS INTEGER) AS n FROM (SELECT file, trim(unnest(string_split(content, chr(10)))) AS l FROM ({SOURCES}))
WHERE l <> '' AND NOT starts_with(l, '//') GROUP BY file""")
def artifacts(spark, d):
    return sources(spark, d).select("file", F.size(ve.artifact_lines(F.col("content"))).alias("n"))


@query("""SELECT doc_id, CASE WHEN len(l) = 0 THEN FALSE ELSE NOT (ends_with(l[-1], ';') OR ends_with(l[-1], '{') OR ends_with(l[-1], '}') OR ends_with(l[-1], '*/')) END AS truncated
FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '//')) AS l FROM documents)""")
def truncation(spark, d):
    return read(spark, d, "documents").select("doc_id", ve.truncated(F.col("text")).alias("truncated"))


@query("""SELECT doc_id, source AS author, lang AS version FROM documents""")
def metadata(spark, d):
    src = F.concat(F.lit('#property Author "'), F.col("source"), F.lit('"\n// #property author "no"\n#property version "'), F.col("lang"), F.lit('"\n#property author "again"\n'))
    m = ve.metadata(src)
    return read(spark, d, "documents").select("doc_id", F.try_element_at(m, F.lit("author")).alias("author"), F.try_element_at(m, F.lit("version")).alias("version"))


def unbalanced(marks: str) -> str:
    """SQL: whether code ``c`` is out of balance in a pair of marks: a prefix closes more than it opens, or the whole does not even out."""
    a, b = marks
    depth = lambda t: f"length(replace({t}, '{b}', '')) - length(replace({t}, '{a}', ''))"
    m = rf"regexp_replace(c, '[^\{a}\{b}]', '', 'g')"
    return f"NOT ({depth(m)} = 0 AND coalesce(list_min(list_transform(range(1, length({m}) + 1), lambda i: {depth(f'left({m}, i)')})), 0) >= 0)"


MARKS_SQL = ", ".join(f"CASE WHEN regexp_matches(l, '{p}') THEN struct_pack(severity := 'warning', \"check\" := 'artifacts', detail := '{says}: ' || CASE WHEN length(l) > 80 THEN left(l, 80) || '...' ELSE l END) END" for p, says in zip((r"\bTODO\b", r"\bFIXME\b", r"(?i)\bplaceholder\b", "<[^>]*your[^>]*>", r"\.\.\.\s*$"), (says for _, says in ve.ARTIFACTS), strict=True))


def finding_sql(test: str, severity: str, check: str, detail: str) -> str:
    return f"CASE WHEN {test} THEN [struct_pack(severity := '{severity}', \"check\" := '{check}', detail := '{detail}')] ELSE [] END"


FOUND = f"""(SELECT video_id, file, kind, list_concat({finding_sql(unbalanced("{}"), "error", "balance", "unbalanced {}")}, {finding_sql(unbalanced("()"), "error", "balance", "unbalanced ()")},
  {finding_sql("kind = 'ea' AND NOT contains(content, 'OnInit')", "error", "entry_points", "missing OnInit")}, {finding_sql("kind = 'ea' AND NOT contains(content, 'OnTick')", "error", "entry_points", "missing OnTick")},
  {finding_sql("NOT contains(content, '#property strict')", "warning", "property_strict", "missing #property strict")},
  list_filter(flatten(list_transform(lines, lambda l: [{MARKS_SQL}])), lambda x: x IS NOT NULL),
  {finding_sql("len(lines) > 0 AND NOT regexp_matches(lines[-1], '(;|[{]|[}]|[*]/)$')", "warning", "truncation", "last line ends no statement")}) AS found
FROM (SELECT *, {CODE_SQL.format("content")} AS c, list_filter(list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g')), lambda x: x <> '' AND NOT starts_with(x, '//')) AS lines,
  CASE WHEN contains(content, 'OnCalculate') THEN 'indicator' WHEN contains(content, 'OnStart') THEN 'script' WHEN contains(content, 'OnInit') OR contains(content, 'OnTick') THEN 'ea' ELSE 'unknown' END AS kind FROM ({SOURCES})))"""
SCORED = f"""(SELECT video_id, file, kind AS program_type, greatest(0.0::DOUBLE, list_reduce(list_prepend(1.0::DOUBLE, list_transform(found, lambda f: CASE WHEN f.severity = 'error' THEN 0.25::DOUBLE ELSE 0.05::DOUBLE END)), lambda a, b: a - b)) AS confidence FROM {FOUND})"""


@query(f"""SELECT video_id, file, CAST(k - 1 AS INTEGER) AS pos, found[k].severity AS severity, found[k]."check" AS "check", found[k].detail AS detail FROM (SELECT *, unnest(range(1, len(found) + 1)) AS k FROM {FOUND})""")
def finding_rows(spark, d):
    return ve.findings(sources(spark, d))


@query(f"SELECT * FROM {SCORED}")
def confidence(spark, d):
    return ve.confidence(sources(spark, d))


@query(f"SELECT video_id, round(avg(confidence), 9) AS confidence FROM {SCORED} GROUP BY video_id")
def overall(spark, d):
    return ve.overall(ve.confidence(sources(spark, d))).select("video_id", F.round("confidence", 9).alias("confidence"))


@query(f"SELECT * FROM {SCORED} WHERE confidence < 0.9")
def gate(spark, d):
    return ve.gate(ve.confidence(sources(spark, d)), 0.9)


@query("""SELECT item_id, tok, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{Nd}_]+|[^\\s\\x{85}\\x{a0}]')) AS tok FROM benchmark) GROUP BY ALL""")
def tokens(spark, d):
    return fi.token_counts(read(spark, d, "benchmark"), ["item_id"], F.col("text"))


def neighbours(spark, d) -> DataFrame:
    """Each document with the next one of its source."""
    docs = read(spark, d, "documents").select("doc_id", "source", "text")
    after = shifted(docs, "source", "doc_id", F.col("text"), "next", ahead=True).filter("next is not null")
    return after.select(F.col("doc_id").alias("pair_id"), "source", F.col("text").alias("golden"), F.col("next").alias("output"))


F1 = """WITH p AS (SELECT doc_id AS pair_id, source, text AS golden, lead(text) OVER (PARTITION BY source ORDER BY doc_id) AS output FROM documents),
q AS (SELECT * FROM p WHERE output IS NOT NULL),
g AS (SELECT pair_id, tok, count(*) AS n FROM (SELECT pair_id, unnest(regexp_extract_all(golden, '[\\p{L}\\p{Nd}_]+|[^\\s\\x{85}\\x{a0}]')) AS tok FROM q) GROUP BY ALL),
o AS (SELECT pair_id, tok, count(*) AS n FROM (SELECT pair_id, unnest(regexp_extract_all(output, '[\\p{L}\\p{Nd}_]+|[^\\s\\x{85}\\x{a0}]')) AS tok FROM q) GROUP BY ALL),
m AS (SELECT pair_id, CAST(sum(coalesce(g.n, 0)) AS BIGINT) AS golden_tokens, CAST(sum(coalesce(o.n, 0)) AS BIGINT) AS output_tokens, sum(least(coalesce(g.n, 0), coalesce(o.n, 0))) AS matched FROM g FULL JOIN o USING (pair_id, tok) GROUP BY pair_id),
s AS (SELECT pair_id, source, coalesce(golden_tokens, 0) AS golden_tokens, coalesce(output_tokens, 0) AS output_tokens, CASE WHEN output_tokens > 0 THEN matched / output_tokens ELSE 0.0 END AS p, CASE WHEN golden_tokens > 0 THEN matched / golden_tokens ELSE 0.0 END AS r FROM q LEFT JOIN m USING (pair_id))
"""


@query(F1 + "SELECT pair_id, golden_tokens, output_tokens, round(p, 9) AS precision, round(r, 9) AS recall, CASE WHEN p + r > 0 THEN round(2 * p * r / (p + r), 9) ELSE 0.0 END AS f1 FROM s")
def multiset_f1(spark, d):
    found = fi.compare(neighbours(spark, d))
    return found.select("pair_id", "golden_tokens", "output_tokens", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query(F1 + "SELECT source, min(CASE WHEN p + r > 0 THEN round(2 * p * r / (p + r), 9) ELSE 0.0 END) AS f1 FROM s GROUP BY source")
def worst_f1(spark, d):
    scored = fi.compare(neighbours(spark, d), carry=("source",))
    worst = scored.groupBy("source").agg(F.min_by(F.struct("f1", "pair_id"), F.struct("f1", "pair_id")).alias("w"))
    return worst.select("source", F.round("w.f1", 9).alias("f1"))


@query("""SELECT tok FROM (SELECT unnest(regexp_extract_all(text, '[\\p{L}\\p{Nd}_]+|[^\\s\\x{85}\\x{a0}]')) AS tok FROM benchmark)
INTERSECT ALL SELECT tok FROM (SELECT unnest(regexp_extract_all(text, '[\\p{L}\\p{Nd}_]+|[^\\s\\x{85}\\x{a0}]')) AS tok FROM documents)""")
def intersect_all(spark, d):
    tok = F.explode(fi.tokens(F.col("text"))).alias("tok")
    return read(spark, d, "benchmark").select(tok).intersectAll(read(spark, d, "documents").select(tok))


@query("""SELECT page_id, CASE WHEN page_id % 4 IN (0, 1, 2) THEN 'id' || lpad(CAST(page_id AS VARCHAR), 9, '0') END AS video_id FROM pages""")
def video_ids(spark, d):
    i = F.concat(F.lit("id"), F.lpad(F.col("page_id").cast("string"), 9, "0"))
    k = F.col("page_id") % 4
    url = F.when(k == 0, F.concat(F.lit("https://www.youtube.com/watch?t=1&v="), i)).when(k == 1, F.concat(F.lit("https://youtu.be/"), i, F.lit("?t=3"))).when(k == 2, F.concat(F.lit(" https://m.youtube.com/shorts/"), i)).otherwise(F.col("url"))
    return read(spark, d, "pages").withColumn("u", url).select("page_id", T.video_id(F.col("u")).alias("video_id"))


@query("""SELECT page_id, regexp_full_match(string_split(url, '/')[-1], '[A-Za-z0-9_-]{1,128}') AS valid FROM pages""")
def run_id_valid(spark, d):
    return read(spark, d, "pages").select("page_id", T.run_id_valid(T.basename(F.col("url"))).alias("valid"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, d):
    return read(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS video_id, sha256(text) AS input_hash FROM documents
WHERE NOT coalesce(text IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), FALSE)""")
def incremental_skip(spark, d):
    work = read(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("video_id"), F.lit("segment").alias("stage"), T.content_hash(F.col("text")).alias("input_hash"))
    made = work.join(read(spark, d, "labels").filter("quality = 1"), "doc_id", "left_semi")
    done = made.select("video_id", "stage", "input_hash", F.lit("done").alias("status"), F.timestamp_seconds(F.lit(0)).alias("finished"))
    return pending(work.drop("doc_id"), done).select("video_id", "input_hash")


@query(f"""SELECT video_id, chunk_id, op, CASE WHEN conv = 0 THEN 1 ELSE 0 END AS kind FROM (SELECT video_id, chunk_id, CASE WHEN CAST(video_id AS BIGINT) % 5 = 0 THEN NULL ELSE op END AS op, CAST(video_id AS BIGINT) % 5 AS conv FROM ({SEEDED}))""")
def export_rows(spark, d):
    e = seeded_events(spark, d)
    bad = F.col("video_id").cast("long") % 5 == 0
    failed = e.filter(bad).select("video_id", "chunk_id", F.lit("bad file").alias("error"))
    return export_union(e.filter(~bad), failed).select("video_id", "chunk_id", "op", "kind")
