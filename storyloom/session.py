"""Session, shared-folder and size-check helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_MAX_ROWS = 200_000


def build_session(app: str = "storyloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    existing = sc.getCheckpointDir()
    if existing:
        return existing
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_WRITTEN: list[str] = []


def _hadoop(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_path(spark: SparkSession, path: str) -> None:
    place, files = _hadoop(spark, path)
    files.delete(place, True)


def list_paths(spark: SparkSession, pattern: str) -> list[str]:
    """The files and folders that match a glob, in any file system that Spark reads."""
    place, files = _hadoop(spark, pattern)
    return [str(status.getPath().toString()) for status in files.globStatus(place) or []]


def release_scratch(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables that ``materialize`` wrote after its first ``since`` ones, once no result that reads them is
    wanted; returns their number. ``scratch_count`` at the start of a job limits this to what the job wrote."""
    for path in _WRITTEN[since:]:
        delete_path(spark, path)
    n = len(_WRITTEN) - since
    del _WRITTEN[since:]
    return n


def scratch_count() -> int:
    return len(_WRITTEN)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing a table to the shared folder and reading it back; see ``release_scratch``."""
    path = scratch_path(df.sparkSession, name)
    _WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; past ``max_rows`` the plain (AQE) join is used."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def broadcast_of(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS):
    """``F.broadcast`` for what is made of a stored table that was counted as small, else a function that does nothing."""
    return F.broadcast if df.limit(max_rows + 1).count() <= max_rows else lambda made: made
