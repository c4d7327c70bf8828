"""Intermediate tables in the shared folder, and the bounds that hold for all operators here."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of keys that may be spread, the most ways a key's rows are spread to, and the rows of a slot that always stay together.
SLOTS, WAYS, TOGETHER = 1 << 16, 256, 256
#: Rows of one Arrow batch between the JVM and Python: bounds a worker's memory for long texts.
ARROW_ROWS = 1000

_FALLBACK: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset (a local session, as in tests) is a temporary folder of this machine taken.
    """
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


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/recordloom-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again.

    Cuts the lineage so that a lost executor costs a read instead of the whole history, and lets several
    consumers share one computation. The table outlives the call because the result is lazy; drop_tables()
    or the cluster's clean-up of its checkpoint folder removes it.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_join(rows: DataFrame, keyed: DataFrame, on: str, by: str, counted: DataFrame | None = None) -> DataFrame:
    """Inner join with keyed, which has few rows for each value of `on`, where a value may be very frequent in rows.

    Rows of a frequent value are dealt by `by` to WAYS ways at most, and keyed's are repeated for each way. A broadcast
    table says how many ways; it has a row for each slot (a hash of `on`) with more than its share, 4096 rows at most.
    counted is a written table that has the values of rows as often as they do; rows itself by default.
    """
    counted = rows if counted is None else counted
    share = max(TOGETHER, counted.count() // 4096)
    slot = F.pmod(F.xxhash64(on), F.lit(SLOTS))
    hot = counted.groupBy(slot.alias("slot")).agg(F.count("*").alias("most")).where(F.col("most") > share)
    hot = hot.select("slot", F.least(F.ceil(F.col("most") / share), F.lit(WAYS)).cast("int").alias("ways"))
    none = rows.sparkSession.range(1).select(F.lit(-1).cast("long").alias("slot"), F.lit(1).alias("ways"))  # no value's: the plan is the same without frequent values
    hot = materialize(hot.select(F.col("slot").cast("long").alias("slot"), "ways").unionByName(none), "hot-slots")
    ways = F.coalesce("ways", F.lit(1))
    left = rows.withColumn("slot", slot).join(F.broadcast(hot), "slot", "left").withColumn("way", F.pmod(F.xxhash64(by), ways).cast("int"))
    right = keyed.withColumn("slot", slot).join(F.broadcast(hot), "slot", "left").withColumn("way", F.explode(F.sequence(F.lit(0), ways - 1)))
    return left.drop("slot", "ways").join(right.drop("slot", "ways"), [on, "way"]).drop("way")


def drop_tables(spark: SparkSession) -> None:
    """Deletes every table that materialize() left in the shared folder."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    pattern = jvm.org.apache.hadoop.fs.Path(shared_folder(spark) + "/recordloom-*")
    fs = pattern.getFileSystem(conf)
    for status in fs.globStatus(pattern) or []:
        fs.delete(status.getPath(), True)


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to ARROW_ROWS if it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
