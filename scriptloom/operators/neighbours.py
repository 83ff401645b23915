"""The row before or after in the order of a key whose rows no single task could hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shifted(df: DataFrame, key: str, order: str, value: Column, name: str, ahead: bool = False, block: int = 4096) -> DataFrame:
    """``df`` with ``name``: ``value`` of the row before (``ahead``: after) within ``key`` in the order of the whole numbers
    ``order``, each once in a key; null for the first.

    Rows meet by key and block of ``block`` numbers. Only a block's first row looks beyond it, to the last row of the
    nearest block that has any, which a table of one row per block tells."""
    step = -1 if ahead else 1
    blocked = df.withColumn("_block", F.floor(F.col(order) / block)).withColumn("_value", value)
    pick = F.min_by if ahead else F.max_by
    edges = blocked.groupBy(key, "_block").agg(pick(F.struct("_value"), F.col(order)).alias("_edge"))
    beyond = edges.select(F.col(key).alias("_key"), F.col("_block").alias("_of"), F.lag("_edge", step).over(Window.partitionBy(key).orderBy("_block")).alias("_beyond"))
    here = F.lag(F.struct("_value"), step).over(Window.partitionBy(key, "_block").orderBy(order))
    joined = blocked.withColumn("_here", here).join(beyond, F.col(key).eqNullSafe(F.col("_key")) & F.col("_block").eqNullSafe(F.col("_of")), "left")
    return joined.select(*df.columns, F.coalesce("_here", "_beyond")["_value"].alias(name))
