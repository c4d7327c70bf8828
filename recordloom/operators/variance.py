"""Shares of variance between groups, in closed form from grouped moments.

One pass over the stays gives moments per (metric, group); everything after that works on tables of group size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_metrics(df: DataFrame, metrics: list[str], keep: list[str]) -> DataFrame:
    """Rows (keep..., metric, y) for non-null metric values."""
    cols = [F.col(m).cast("double").alias(m) for m in metrics]
    return df.select(*keep, *cols).unpivot(keep, metrics, "metric", "y").where("y is not null")


def _everything() -> Window:
    return Window.partitionBy("metric")


def cell_moments(long: DataFrame, groups: list[str]) -> DataFrame:
    """n, mean and squared deviations of y per (metric, groups...)."""
    return long.groupBy("metric", *groups).agg(F.count("*").alias("n"), F.avg("y").alias("mean"), (F.var_pop("y") * F.count("*")).alias("m2"))


def metric_moments(df: DataFrame, metrics: list[str], groups: list[str]) -> DataFrame:
    """cell_moments() of whole columns: all metrics in one aggregation, turned to rows when they are few."""
    aggs = []
    for m in metrics:
        y = F.col(m).cast("double")
        aggs += [F.count(y).alias(f"{m}__n"), F.avg(y).alias(f"{m}__mean"), (F.var_pop(y) * F.count(y)).alias(f"{m}__m2")]
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}__n").alias("n"), F.col(f"{m}__mean").alias("mean"), F.col(f"{m}__m2").alias("m2")) for m in metrics])
    return df.groupBy(*groups).agg(*aggs).select(*groups, F.inline(rows)).where("n > 0").select("metric", *groups, "n", "mean", "m2")


def eta2_of_cells(cells: DataFrame, group: Column, name: str = "eta2", least: int = 10) -> DataFrame:
    """(metric, name, n) from moments of cells that lie within the groups.

    A null group counts in the total and not between groups. Null under `least` rows or without variance.
    """
    base = cells.withColumn("g", group)
    grand = F.sum(F.col("n") * F.col("mean")).over(_everything()) / F.sum("n").over(_everything())
    centred = base.withColumn("grand", grand)
    total = centred.groupBy("metric").agg(F.sum("n").alias("rows"), F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("grand")) ** 2).alias("sst"))
    means = centred.where(F.col("g").isNotNull()).groupBy("metric", "g").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.first("grand").alias("grand"))
    between = means.groupBy("metric").agg(F.sum(F.col("n") * (F.col("mean") - F.col("grand")) ** 2).alias("ssb"))
    value = F.when((F.col("rows") >= least) & (F.col("sst") > 0), F.col("ssb") / F.col("sst"))
    return total.join(between, "metric", "left").select("metric", value.alias(name), F.col("rows").alias("n"))


def eta2(df: DataFrame, metrics: list[str], group: str, name: str = "eta2", least: int = 10) -> DataFrame:
    """Share of each metric's variance between groups: (metric, eta2, n)."""
    return eta2_of_cells(metric_moments(df, metrics, [group]), F.col(group), name, least)


def nested_r2(df: DataFrame, metrics: list[str], least: int = 100) -> DataFrame:
    """Increments of explained variance over database, hospital, unit; groups roll up from unit cells."""
    cells = metric_moments(df, metrics, ["database", "hospital", "unit_id"])
    parts = [eta2_of_cells(cells, F.col(g), f"r_{g}", least) for g in ("database", "hospital", "unit_id")]
    joined = parts[0].join(parts[1].drop("n"), "metric").join(parts[2].drop("n"), "metric")
    return joined.select(
        "metric",
        "n",
        F.col("r_database").alias("r2_database"),
        (F.col("r_hospital") - F.col("r_database")).alias("r2_hospital"),
        (F.col("r_unit_id") - F.col("r_hospital")).alias("r2_unit"),
        F.col("r_unit_id").alias("r2_total"),
    )


def unit_within_hospital(df: DataFrame, metrics: list[str]) -> DataFrame:
    """eta2 of units less eta2 of hospitals, from the moments of unit cells."""
    cells = metric_moments(df, metrics, ["hospital", "unit_id"])
    both = eta2_of_cells(cells, F.col("hospital"), "eta2_hospital").join(eta2_of_cells(cells, F.col("unit_id"), "eta2_unit").drop("n"), "metric")
    return both.withColumn("eta2_unit_within", F.col("eta2_unit") - F.col("eta2_hospital"))


def _with_covariate(df: DataFrame, metrics: list[str], covariate: Column, group: str) -> DataFrame:
    """(metric, group, x, y), both centred over the metric's rows to keep sums small."""
    base = df.withColumn("__x", covariate.cast("double"))
    long = long_metrics(base, metrics, [group, "__x"]).where("__x is not null").withColumnRenamed("__x", "x")
    centre = long.groupBy("metric").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return long.join(F.broadcast(centre), "metric").select("metric", group, (F.col("x") - F.col("cx")).alias("x"), (F.col("y") - F.col("cy")).alias("y"))


def pair_moments(df: DataFrame, metrics: list[str], covariate: Column, group: str) -> DataFrame:
    """Counts, sums and cross-products of covariate x and metric y per (metric, g), both centred over the metric's rows."""
    return _with_covariate(df, metrics, covariate, group).groupBy("metric", F.col(group).alias("g")).agg(
        F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("y") * F.col("y")).alias("syy")
    )


def partial_eta2(df: DataFrame, metrics: list[str], covariate: Column, group: str, least: int = 100) -> DataFrame:
    """(R2 of group and covariate - R2 of covariate) / (1 - R2 of covariate) of a linear model.

    Within groups the residual sum of squares is Wyy - Wxy^2 / Wxx. Null under `least` rows, if the covariate
    explains more than 0.999, or without variance.
    """
    m = pair_moments(df, metrics, covariate, group)
    within = lambda s, a, b: F.sum(F.col(s) - F.col(a) * F.col(b) / F.col("n"))
    rolled = m.groupBy("metric").agg(
        F.sum("n").alias("n"),
        *[F.sum(c).alias(c) for c in ("sx", "sy", "sxx", "sxy", "syy")],
        within("sxx", "sx", "sx").alias("wxx"),
        within("sxy", "sx", "sy").alias("wxy"),
        within("syy", "sy", "sy").alias("wyy"),
    )
    txx, txy, tyy = F.col("sxx") - F.col("sx") ** 2 / F.col("n"), F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"), F.col("syy") - F.col("sy") ** 2 / F.col("n")
    base = F.when((txx > 0) & (tyy > 0), txy * txy / (txx * tyy)).otherwise(0.0)
    slope = F.when(F.col("wxx") > 0, F.col("wxy") ** 2 / F.col("wxx")).otherwise(0.0)
    rolled = rolled.withColumn("r2_base", base).withColumn("tyy", tyy).withColumn("r2_full", F.when(tyy > 0, 1 - (F.col("wyy") - slope) / tyy))
    value = F.when((F.col("n") >= least) & (F.col("tyy") > 0) & (F.col("r2_base") <= 0.999), (F.col("r2_full") - F.col("r2_base")) / (1 - F.col("r2_base")))
    return rolled.select("metric", "n", value.alias("partial_eta2"))


def residual_eta2(df: DataFrame, metrics: list[str], covariate: Column, group: str, least: int = 10) -> DataFrame:
    """eta2 of the residuals of a straight line on the covariate (the values themselves under `least` rows or without spread)."""
    long = _with_covariate(df, metrics, covariate, group)
    line = long.groupBy("metric").agg(F.count("*").alias("rows"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("x") * F.col("x")).alias("sxx"))
    slope = F.when((F.col("rows") >= least) & (F.col("sxx") > 0), F.col("sxy") / F.col("sxx")).otherwise(0.0)
    residual = long.join(F.broadcast(line), "metric").select("metric", group, (F.col("y") - slope * F.col("x")).alias("y"))
    return eta2_of_cells(cell_moments(residual, [group]), F.col(group), "eta2_given_density")
