"""Queries ``opN_<name>``: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptloom.llm.bpe import byte_bpe
from scriptloom.llm.chat import chat_digest
from scriptloom.llm.common import LOWER, UPPER, table
from scriptloom.llm.exact_dedup import exact_dedup
from scriptloom.llm.line_dedup import line_dedup
from scriptloom.llm.media import media_features
from scriptloom.llm.near_dedup import near_dedup
from scriptloom.llm.packing import best_fit_packing
from scriptloom.llm.quality import quality
from scriptloom.llm.repeats import remove_repeats
from scriptloom.llm.toxicity import toxicity


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def conversation_log(conversations: DataFrame) -> DataFrame:
    """The rows of conversations as a log. Every third message arrives in two deltas, every third is drafted and
    regenerated, every third is begun and then edited; the outcome is always the row's text. Rows that share a turn
    are messages of their own, ordered by role and text."""
    text = F.coalesce("text", F.lit(""))
    half = F.char_length(text) / 2
    head, tail = F.substring(text, F.lit(1), half.cast("int")), F.substring(text, half.cast("int") + 1, F.char_length(text))
    steps = {
        0: [("open", ""), ("delta", head), ("delta", tail)],
        1: [("open", ""), ("delta", "draft"), ("regenerate", ""), ("delta", head), ("delta", tail)],
        2: [("open", ""), ("delta", head), ("edit", text)],
    }

    def log(way):
        return F.array(*[F.struct(F.lit(i).cast("long").alias("step"), F.lit(kind).alias("kind"), (F.lit(p) if isinstance(p, str) else p).alias("payload")) for i, (kind, p) in enumerate(steps[way])])

    way = F.pmod(F.coalesce("turn", F.lit(0)), F.lit(3))
    alike = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("alt", F.row_number().over(alike).cast("long"))
    events = rows.withColumn("e", F.explode(F.when(way == 0, log(0)).when(way == 1, log(1)).otherwise(log(2))))
    order = F.array(F.coalesce("turn", F.lit(-(2**63))).cast("long"), F.col("alt"), F.col("e.step"))
    return events.select("conv_id", "turn", "alt", order.alias("seq"), "e.kind", "role", "e.payload")


TRICKY = "\\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = "conv_id long, turn long, role string, text string"
    extra = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], columns)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_digest(conversation_log(rows))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = f"""
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP7_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
g AS (SELECT key, max(doc_id) AS m FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, (g.key IS NOT NULL AND doc_id <> m) AS dropped FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_media": op3_media,
    "op4_toxicity": op4_toxicity,
    "op5_near_dedup": op5_near_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_suffix_array": op10_suffix_array,
}

ORACLES = {
    "op6_exact_dedup": OP6_SQL,
    "op7_line_dedup": OP7_SQL,
}
