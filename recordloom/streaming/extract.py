"""Extraction over files that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recordloom.config import DEFAULT, Config
from recordloom.operators.events import in_window


def arriving(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    """New Parquet files under a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def window_events(stream: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(stay_key, offset_min) events within the window; no state is kept."""
    return in_window(stream.where(F.col("stay_key").isNotNull()), config)


def hourly_volume(stream: DataFrame, time_col: str = "ts", item_col: str = "item", late: str = "1 hour") -> DataFrame:
    """Records per item and hour; an hour is closed once the watermark is `late` past it."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, "1 hour").alias("w"), F.col(item_col)).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), item_col, "n")


def to_parquet(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends to a Parquet table; with once set, it handles what there is and stops."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
