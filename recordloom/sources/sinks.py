"""Result writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, order: list[Column] | None = None) -> None:
    """CSV files with a header each, written in parallel; with order, names of files sort as their rows do."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    ranged.write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path: str, title: str, order: list[Column] | None = None, columns: list[str] | None = None) -> None:
    """A text report: title, empty line, header, then a line for each row in the given order, else df's, of the given columns.

    Lines are written in ranges of the order, in parallel; files sort by name as their lines do, the head's first.
    Whoever needs one file strings them together; read_report() tells the places of lines. Nulls are empty.
    """
    spark = df.sparkSession
    columns = df.columns if columns is None else columns
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    body = ranged.select(F.concat_ws("\t", *[text(c) for c in columns]).alias("value"))
    head = spark.createDataFrame([(title,), ("",), ("\t".join(columns),)], "value string")
    head.coalesce(1).union(body).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(place, value): the lines of a report with their places from 0, over all its files."""
    from recordloom.operators.ranges import numbered

    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("nth"))
    return numbered(lines, [F.col("file"), F.col("start"), F.col("nth")], "place").select("place", "value")
