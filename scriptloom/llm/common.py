"""Helpers shared by the training-data operators: table access, shared storage and Arrow batch sizes."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only, so that letters outside ASCII keep their identity."""
    return F.translate(col, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only where none is configured."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by the cluster")
        base = "file://" + os.path.join(tempfile.gettempdir(), "scriptloom-shared")
    return base.rstrip("/")


_KEPT: set[str] = set()


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own part of the shared folder, which goes when its JVM ends."""
    own = f"{shared_dir(spark)}/scriptloom-{spark.sparkContext.applicationId}"
    if own not in _KEPT:
        _KEPT.add(own)
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{own}/{name}-{uuid.uuid4().hex}"


#: Whether the shuffle files of a query go as it ends; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage is cut and a lost executor loses nothing. What the
    write has shuffled goes as it ends."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        # the plan is made anew, so that it has the setting and shares no shuffle with a later use of ``df``
        writer = df.select("*").write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    for paths in _SCOPES:
        paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


_SCOPES: list[list[str]] = []


@contextmanager
def noted():
    """The paths of the tables that are stored within."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield paths
    finally:
        _SCOPES[:] = [p for p in _SCOPES if p is not paths]


def drop(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Removes stored tables that nothing will read again; without this they go when the application ends."""
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ready_python(spark: SparkSession, rows: int = 512) -> None:
    """Before Python stages: bounds what a worker holds at once (batches of at most ``rows`` possibly long texts) and
    sends the package to the executors, which need not have it on their path."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        archive = os.path.join(tempfile.mkdtemp(), f"{package.name}.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(app)
