"""From event tables to (stay, offset) events and per-stay metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.config import DEFAULT, Config
from recordloom.functions import scalars as S


def in_window(events: DataFrame, config: Config = DEFAULT, column: str = "offset_min") -> DataFrame:
    """Offsets in [0, window); on a raw column the predicate reaches the scan."""
    return events.where((F.col(column) >= 0) & (F.col(column) < config.window_min))


def timestamped(events: DataFrame, stays: DataFrame, item: str | int, lo: float, hi: float, config: Config = DEFAULT, exact: bool = True) -> DataFrame:
    """Events of one item with values in [lo, hi], within the window after the stay's intime.

    events: stay_id, itemid, charttime, valuenum; stays: stay_id, intime, los.
    """
    chosen = events.where((F.col("itemid") == item) & F.col("valuenum").between(lo, hi) & F.col("charttime").isNotNull())
    joined = chosen.join(stays, "stay_id").withColumn("offset_min", S.elapsed_minutes(F.col("intime"), F.col("charttime"), exact))
    return in_window(joined, config).select("stay_id", "charttime", "offset_min", "los")


def textual(events: DataFrame, pattern: str, lo: float, hi: float, config: Config = DEFAULT) -> DataFrame:
    """Events whose label or name matches pattern and whose text value is a number in [lo, hi].

    events: stay_key, offset_min, label, name, value (text).
    """
    match = S.contains_any_case(F.col("label"), pattern) | S.contains_any_case(F.col("name"), pattern)
    return in_window(events.where(match & S.lenient_numeric(F.col("value")).between(lo, hi)), config).select("stay_key", "offset_min")


def unpivoted(wide: DataFrame, ranges: dict[str, tuple[float, float]], keys: tuple[str, ...] = ("stay_key", "offset_min")) -> DataFrame:
    """One event for each column of a wide row that is in its range."""
    long = wide.unpivot(list(keys), [F.col(c).cast("double").alias(c) for c in ranges], "variable", "value")
    return long.where(_in_ranges(ranges))


def _in_ranges(ranges: dict[str, tuple[float, float]], variable: str = "variable", value: str = "value") -> Column:
    found = F.lit(False)
    for name, (lo, hi) in ranges.items():
        found = found | ((F.col(variable) == name) & F.col(value).between(lo, hi))
    return found


def multi_variable(events: DataFrame, names: dict[str, str], ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Events of several items, renamed to variables, each in its own range; one scan for all of them."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    chosen = events.where(F.col("item").isin(*names)).withColumn("variable", table[F.col("item")])
    return chosen.where(_in_ranges(ranges))


def stay_metrics(events: DataFrame, config: Config = DEFAULT, by: tuple[str, ...] = ("stay_key",)) -> DataFrame:
    """One row per stay: record count, first offset and gap statistics (null for a single record).

    The lag and the aggregation need rows by stay: one exchange. Equal offsets give gaps of 0.
    """
    gap = F.col("offset_min") - F.lag("offset_min").over(Window.partitionBy(*by).orderBy("offset_min"))
    gaps = events.withColumn("gap", gap)
    over = lambda t: F.sum(F.when(F.col("gap").isNotNull(), (F.col("gap") > t).cast("long")))
    short, mid, long = config.gap_min
    return gaps.groupBy(*by).agg(
        F.count("*").alias("n_records"),
        (F.min("offset_min") / F.lit(60.0)).alias("t_first_h"),
        F.percentile("gap", F.lit(0.5)).alias("median_interval_min"),
        (F.percentile("gap", F.lit(0.75)) - F.percentile("gap", F.lit(0.25))).alias("iqr_interval_min"),
        F.max("gap").cast("double").alias("max_interval_min"),
        over(short).alias("n_gaps_gt30m"),
        over(mid).alias("n_gaps_gt2h"),
        over(long).alias("n_gaps_gt4h"),
        (F.sum(F.when(F.col("gap").isNotNull(), F.when(F.col("gap") > mid, F.col("gap")).otherwise(0))) / F.lit(float(config.window_min))).alias("frac_time_in_gaps"),
    )


def eligible(metrics: DataFrame, stays: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Metrics of stays that completed the window and have enough records."""
    return metrics.join(stays, "stay_key").where(F.col("completed") & (F.col("n_records") >= config.min_records))


def large_groups(df: DataFrame, group: str, least: int) -> DataFrame:
    """Rows of groups with at least `least` rows: sizes are aggregated, then semi-joined."""
    sizes = df.groupBy(group).agg(F.count("*").alias("__n")).where(F.col("__n") >= least)
    return df.join(sizes.select(group), group, "left_semi")
