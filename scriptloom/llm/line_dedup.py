"""Line deduplication with levelled sorted runs of line hashes, in DataFrame functions only.

Lines arrive in batches. The keys of a batch are merge-anti-joined with the runs: those found nowhere are fresh and
make a new sorted run at level 0; counts and largest ids of the others are merged into the run that holds the key. So
a key lies in one run. When a level holds ``fanout`` runs they are compacted into one run of the next level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.llm.common import ascii_lower, stored

#: Space and the controls 9 to 13.
BLANK = " \t\n\x0b\x0c\r"


class LineRuns:
    """The runs: rows (hi, lo, n_docs, max_doc), each run sorted by its 128-bit key (hi, lo), no key in two runs."""

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]

    def _write(self, run: DataFrame, level: int) -> DataFrame:
        return stored(run.repartition("hi", "lo").sortWithinPartitions("hi", "lo"), f"run-l{level}")

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def fresh(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` (hi, lo, ...) that no run holds."""
        return reduce(lambda left, run: left.join(run.select("hi", "lo"), ["hi", "lo"], "left_anti"), self.runs(), keys)

    def _counted(self, run: DataFrame, batch: DataFrame) -> DataFrame:
        """The run's rows, with what the batch adds to their keys. Null ids are smaller than any other."""
        more = batch.select("hi", "lo", F.col("n_docs").alias("n"), F.col("max_doc").alias("m"))
        return run.join(more, ["hi", "lo"], "left").select("hi", "lo", (F.col("n_docs") + F.coalesce("n", F.lit(0))).alias("n_docs"), F.greatest("max_doc", "m").alias("max_doc"))

    def add(self, batch: DataFrame) -> None:
        """Adds the counted keys (hi, lo, n_docs, max_doc) of a batch, each key once."""
        if self.runs():
            batch = stored(batch, "counted")
        fresh = self._write(self.fresh(batch), 0)
        self.levels = [[self._write(self._counted(run, batch), i) for run in level] for i, level in enumerate(self.levels)]
        self.levels[0].append(fresh)
        for i in range(len(self.levels)):
            if len(self.levels[i]) >= self.fanout:
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(self._write(reduce(DataFrame.unionByName, self.levels[i]), i + 1))
                self.levels[i] = []

    def totals(self) -> DataFrame:
        """One row per key."""
        return reduce(DataFrame.unionByName, self.runs())


def line_keys(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """Rows (doc_id, row_hash, pos, hi, lo), one for each line whose key has at least ``min_chars`` code points."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = F.transform(F.split(ascii_lower(text), "\n"), lambda line: F.btrim(line, F.lit(BLANK)))
    lines = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("row_hash"), F.posexplode(keys).alias("pos", "line"))
    return lines.filter(F.char_length("line") >= min_chars).select(
        "doc_id", "row_hash", "pos", F.xxhash64("line").alias("hi"), F.xxhash64(F.lit(1), "line", F.lit(2)).alias("lo")
    )


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = 4) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept_text.

    A line's key is the line stripped of blanks and with A-Z lower-cased. A key of at least ``min_chars`` code points
    in at least ``min_docs`` documents loses all its lines but those of the largest doc_id that holds it. A line
    repeated in one document counts once. Null or empty text: one empty line. A null id is smaller than any other;
    where all ids of a key are null its lines stay. Rows that repeat id and text count as one document and share
    their result. An empty table gives no rows. Other columns are ignored.
    """
    spark = df.sparkSession
    keyed = line_keys(df, id_col, text_col, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    lines = stored(keyed, "lines", "batch")
    runs = LineRuns(spark)
    for b in range(batches):
        per_doc = lines.filter(F.col("batch") == b).groupBy("hi", "lo", "doc_id", "row_hash").agg(F.lit(1).alias("one"))
        runs.add(per_doc.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc")))
    frequent = stored(runs.totals().filter(F.col("n_docs") >= min_docs).select("hi", "lo", "max_doc"), "frequent")
    dropped = (
        lines.select("doc_id", "row_hash", "pos", "hi", "lo")
        .join(frequent, ["hi", "lo"])
        .filter(F.coalesce(F.col("doc_id") < F.col("max_doc"), F.col("max_doc").isNotNull()))
        .groupBy(F.col("doc_id").alias("d"), F.col("row_hash").alias("r"))
        .agg(F.collect_set("pos").alias("dropped"))
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("doc_id"), text.alias("t")).withColumn("row_hash", F.xxhash64("t"))
    joined = docs.join(dropped, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_hash") == F.col("r")), "left")
    parts = F.split("t", "\n")
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("dropped")), lambda i: F.get(F.col("parts"), i)), "\n")
    return (
        joined.withColumn("parts", parts)
        .select(
            "doc_id",
            F.size("parts").cast("long").alias("n_lines"),
            F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
            F.when(F.col("dropped").isNull(), F.col("t")).otherwise(kept).alias("kept_text"),
        )
    )
