"""One wide row of the study's comparisons for each variable, all variables in the same passes.

Ranks, cuts, moments and percentiles are keyed by variable. Stay metrics of both streams are written once and read by
every part, so each event table is scanned once whatever the number of variables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.operators import agreement as A
from recordloom.operators import events as E
from recordloom.operators import variance as V
from recordloom.operators.ranges import sums_before
from recordloom.sources.scratch import materialize

_BY = ("variable", "stay_key")


def stream_table(nurse: DataFrame, monitor: DataFrame, stays: DataFrame) -> DataFrame:
    """Metrics and groups of eligible stays by (stream, variable), written; nurse and monitor are (variable, stay_key, offset_min)."""
    both = nurse.withColumn("stream", F.lit("nurse")).unionByName(monitor.withColumn("stream", F.lit("monitor")))
    metrics = E.stay_metrics(E.in_window(both), by=("stream", *_BY))
    return materialize(E.eligible(metrics, stays), "stream-metrics")


def keyed_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """(variable, column, name): ranks within a variable, ties averaged."""
    counted = df.groupBy("variable", column).agg(F.count("*").alias("__c"))
    placed = sums_before(counted, ["variable"], [F.col(column)], {"__before": F.col("__c")})
    return placed.select("variable", column, (F.col("__before") + (F.col("__c") + 1) / F.lit(2.0)).alias(name))


def stream_agreement(table: DataFrame, own: str) -> DataFrame:
    """(variable, n_both, spearman, agreement, jaccard): records of the same stays in both streams, outside the database own."""
    side = lambda s, n: table.where((F.col("stream") == s) & (F.col("database") != own)).select(*_BY, F.col("n_records").alias(n))
    pairs = materialize(side("monitor", "a").join(side("nurse", "b"), list(_BY)), "pairs")
    ranked = pairs.join(keyed_ranks(pairs, "a", "ra"), ["variable", "a"]).join(keyed_ranks(pairs, "b", "rb"), ["variable", "b"])
    cut = lambda c: A.quantile(pairs, c, [0.1], ("variable",)).select("variable", F.col("cut").alias(f"cut_{c}"))
    flagged = ranked.join(cut("a"), "variable").join(cut("b"), "variable")
    a, b = F.col("a") <= F.col("cut_a"), F.col("b") <= F.col("cut_b")
    n = lambda c: F.sum(c.cast("long"))
    return flagged.groupBy("variable").agg(
        F.count("*").alias("n_both"),
        F.corr("ra", "rb").alias("spearman"),
        (n(a & b) / F.greatest(n(a), F.lit(1))).alias("agreement"),
        (n(a & b) / F.greatest(n(a | b), F.lit(1))).alias("jaccard"),
    )


def _wide(found: DataFrame, key: str, names: dict[str, str], value: str) -> DataFrame:
    """A column for each of names, where key (after the variable) is one of them."""
    split = found.withColumns({"variable": F.split_part(key, F.lit("|"), F.lit(1)), "__rest": F.substring_index(key, "|", -2)})
    return split.groupBy("variable").agg(*(F.max(F.when(F.col("__rest") == k, F.col(value))).alias(n) for k, n in names.items()))


def database_components(table: DataFrame, own: str, metrics: tuple[str, ...]) -> DataFrame:
    """(variable, database_<metric>_<stream>...): eta2 of the two sides, the database own giving its nurse stream, the others one stream."""
    is_own = F.col("database") == own
    streams = F.when(is_own, F.when(F.col("stream") == "nurse", F.array(F.lit("nurse"), F.lit("monitor")))).otherwise(F.array("stream"))
    sided = table.withColumns({"against": F.explode(streams), "side": is_own})
    long = V.long_metrics(sided, list(metrics), ["variable", "against", "side"])
    keyed = long.withColumn("metric", F.concat_ws("|", "variable", "metric", "against"))
    found = V.eta2_of_cells(V.cell_moments(keyed, ["side"]), F.col("side"))
    return _wide(found, "metric", {f"{m}|{s}": f"database_{m}_{s}" for m in metrics for s in ("nurse", "monitor")}, "eta2")


def hospital_components(table: DataFrame, own: str, metrics: tuple[str, ...], least: int) -> DataFrame:
    """(variable, hospital_<metric>, unit_<metric>...): nurse stream outside own, hospitals of at least `least` stays."""
    nurse = table.where((F.col("stream") == "nurse") & (F.col("database") != own))
    large = nurse.groupBy("variable", "hospital").agg(F.count("*").alias("m")).where(F.col("m") >= least).select("variable", "hospital")
    long = V.long_metrics(nurse.join(large, ["variable", "hospital"], "left_semi"), list(metrics), ["variable", "hospital", "unit_id"])
    cells = V.cell_moments(long.withColumn("metric", F.concat_ws("|", "variable", "metric", F.lit(""))), ["hospital", "unit_id"])
    both = V.eta2_of_cells(cells, F.col("hospital"), "h").join(V.eta2_of_cells(cells, F.col("unit_id"), "u").drop("n"), "metric").withColumn("within", F.col("u") - F.col("h"))
    parts = [_wide(both, "metric", {f"{m}|": f"{label}_{m}" for m in metrics}, value) for label, value in (("hospital", "h"), ("unit", "within"))]
    return parts[0].join(parts[1], "variable")


def unit_positions(table: DataFrame, own: str, least: int) -> DataFrame:
    """(variable, position_min_<stream>, position_max_<stream>...): ranks of own units' median records among the others' units."""
    medians = table.groupBy("variable", "stream", "unit_id", (F.col("database") == own).alias("own")).agg(F.count("*").alias("m"), F.percentile("n_records", F.lit(0.5)).alias("value")).where(F.col("m") >= least)
    medians = materialize(medians, "medians")
    values = medians.where("own and stream = 'nurse'").select("variable", F.explode(F.array(F.lit("nurse"), F.lit("monitor"))).alias("stream"), "value")
    ranked = A.empirical_percentiles(values, medians.where("not own").select("variable", "stream", "value"), ("variable", "stream"), "value")
    each = [f(F.when(F.col("stream") == s, F.col("percentile"))).alias(f"position_{n}_{s}") for s in ("nurse", "monitor") for f, n in ((F.min, "min"), (F.max, "max"))]
    return ranked.groupBy("variable").agg(*each)


def cross_variable_table(nurse: DataFrame, monitor: DataFrame, stays: DataFrame, own: str, *, least_hospital: int, least_cell: int) -> DataFrame:
    """A row for each variable of the nurse or monitor stream that has eligible stays in both, outside own."""
    table = stream_table(nurse, monitor, stays)
    parts = [
        stream_agreement(table, own),
        database_components(table, own, ("n_records", "median_interval_min")),
        hospital_components(table, own, ("n_records", "median_interval_min", "frac_time_in_gaps"), least_hospital),
        unit_positions(table, own, least_cell),
    ]
    return reduce(lambda a, b: a.join(b, "variable", "left"), parts)
