"""Sums along an order that needs no task to see all rows.

Rows are sorted into ranges; sums run within a range, and what earlier ranges bring is one number for each range (and
key). A key may have any share of the rows, as its rows may lie in many ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.sources.scratch import materialize


def sums_before(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with a column for each of sums: the sum of its values over earlier rows with the same keys, 0 for the first.

    The order should tell all rows apart, as rows that tie come in any order. Keys may be none: then there is one sum over
    the whole table, and the driver adds up one row for each range. Null values count as 0; keys may be null.
    """
    values = {f"__v{i}": F.coalesce(v, F.lit(0)) for i, v in enumerate(sums.values())}
    by = [*(F.col(k) for k in keys), *order]
    ordered = df.withColumns(values).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    placed = materialize(ordered, "ranges").withColumn("__part", F.shiftright("__at", 33).cast("int"))
    within = Window.partitionBy("__part", *keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumns({f"__l{v}": F.coalesce(F.sum(v).over(within), F.lit(0)) for v in values})
    totals = placed.groupBy("__part", *keys).agg(*(F.sum(v).alias(f"__t{v}") for v in values))
    if keys:
        earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        brought = totals.select("__part", *keys, *(F.coalesce(F.sum(f"__t{v}").over(earlier), F.lit(0)).alias(f"__b{v}") for v in values))
        renamed = brought.select(F.col("__part").alias("__p"), *(F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)), *(f"__b{v}" for v in values))
        same = [F.col("__part") == F.col("__p"), *(F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys))]
        joined = local.join(renamed, same)
    else:
        rows, so_far, brought = sorted(totals.collect(), key=lambda r: r["__part"]), [None] * len(values), []
        for r in rows:
            brought.append((r["__part"], *so_far))
            so_far = [r[f"__t{v}"] if a is None else a + r[f"__t{v}"] for a, v in zip(so_far, values)]
        kinds = [f"__b{v} {totals.schema[f'__t{v}'].dataType.simpleString()}" for v in values]
        carried = df.sparkSession.createDataFrame(brought, f"__part int, {', '.join(kinds)}")
        joined = local.join(F.broadcast(carried), "__part")  # a row for each range
    return joined.select(*df.columns, *((F.col(f"__l{v}") + F.coalesce(F.col(f"__b{v}"), F.lit(0))).alias(name) for name, v in zip(sums, values)))


def numbered(df: DataFrame, order: list[Column], name: str = "row") -> DataFrame:
    """df with the place of each row in that order, from 0."""
    return sums_before(df, [], order, {name: F.lit(1).cast("long")})
