"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own content says so, each chunk gets an identifier, and documents are compared by their
ordered identifier lists: a long document moves once, as chunks that equal chunks elsewhere absorb before the
shuffle, and afterwards only its list of 16-byte identifiers moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import ascii_lower, stored

#: A chunk has 1,024 to 8,192 characters and ends after the first "n, s or t, white space, a to h" from its 1,024th on.
CHUNK_PATTERN = r"(?s).{1024,8192}?(?:(?<=[nst]\s[a-h])|\z)|.{1,8192}"


def identifier(chunk: Column) -> Column:
    """128 bits of a chunk's content."""
    return F.struct(F.xxhash64(chunk).alias("a"), F.xxhash64(F.lit(1), chunk, F.lit(2)).alias("b"))


def chunk_recipes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, recipe, an array of identifiers, n_bytes, text_sha256) of the normalised texts; null text counts as
    empty."""
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return df.select(F.col(id_col).alias("doc_id"), text.alias("t")).select(
        "doc_id",
        F.transform(F.regexp_extract_all("t", F.lit(CHUNK_PATTERN), F.lit(0)), identifier).alias("recipe"),
        F.octet_length("t").alias("n_bytes"),
        F.sha2("t", 256).alias("text_sha256"),
    )


def colliding_identifiers(df: DataFrame, text_col: str) -> DataFrame:
    """Identifiers that stand for more than one chunk content. Chunks are compared whole, after equal ones have been
    absorbed on the map side, so a group of copies of any size costs one chunk per task."""
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    chunks = df.select(F.explode(F.regexp_extract_all(text, F.lit(CHUNK_PATTERN), F.lit(0))).alias("c"))
    distinct = chunks.select(identifier(F.col("c")).alias("h"), "c").groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"))
    return distinct.groupBy("h").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1").select("h")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Nulls: a null text is empty, empty texts equal each other;
    a null id never wins over another, and a group of null ids only has a null keep_id (its rows are kept). Repeated
    rows with one id count in group_size and share the verdict of that id. An empty table gives no rows. Other
    columns are ignored, whatever their names.
    """
    recipes = stored(chunk_recipes(df, id_col, text_col), "recipes")
    key = ["recipe", "n_bytes", "tie"]
    recipes = recipes.withColumn("tie", F.lit(""))
    shared = colliding_identifiers(df, text_col)
    if not (shared := stored(shared, "colliding")).isEmpty():
        # where contents share an identifier, the lists that hold it stand for more than one text: its digest decides
        doubtful = recipes.select("recipe", "n_bytes", F.explode("recipe").alias("h")).join(shared, "h", "left_semi").select("recipe", "n_bytes", F.lit(True).alias("doubtful")).distinct()
        recipes = recipes.join(doubtful, ["recipe", "n_bytes"], "left").withColumn("tie", F.when(F.col("doubtful"), F.col("text_sha256")).otherwise(""))
    groups = stored(recipes.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    return recipes.join(groups, key).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
