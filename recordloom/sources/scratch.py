"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session where that is unset, as in tests, takes a temporary folder of its machine."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        folder = tempfile.mkdtemp(prefix="recordloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _FALLBACK[app] = "file://" + folder
    return _FALLBACK[app]


def _own(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/recordloom-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{_own(spark)}-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again.

    Cuts the lineage, so that a lost executor costs a read instead of the whole history, and lets several consumers
    share one computation. The table outlives the call because the result is lazy; drop_tables() or the cluster's
    clean-up of its checkpoint folder removes it.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Deletes the tables that materialize() left for this application; those of others in the folder stay."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(_own(spark) + "-*")
    fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.globStatus(pattern) or []:
        fs.delete(status.getPath(), True)
