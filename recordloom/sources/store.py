"""An event store: extracted events as tables bucketed by stay, so that what is by stay needs no exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from recordloom.sources.scratch import new_path

KEY = "stay_key"


def write_events(events: DataFrame, buckets: int, name: str | None = None, path: str | None = None) -> str:
    """Writes events as a table in `buckets` buckets of stays, sorted by stay and offset; returns the table's name.

    Events are dealt by the hash that buckets go by, so each bucket is one file. Tables that are to be joined by stay
    without an exchange have the same number of buckets: enough for one bucket to fit a task. The files lie under path,
    by default in the shared folder; the session's catalog has the name. A stay's events are all in one bucket.
    """
    name = name or f"recordloom_events_{uuid.uuid4().hex}"
    dealt = events.repartition(buckets, KEY)
    order = [KEY, *(c for c in ("offset_min",) if c in events.columns)]
    dealt.write.format("parquet").bucketBy(buckets, KEY).sortBy(*order).option("path", path or new_path(events.sparkSession, "store")).saveAsTable(name)
    return name


def events(spark: SparkSession, name: str) -> DataFrame:
    """The store's events; lags, aggregations and joins by stay read bucket by bucket."""
    return spark.table(name)


def drop_events(spark: SparkSession, name: str) -> None:
    """Forgets the table; files under a given path stay."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")

