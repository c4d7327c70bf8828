"""Quantile flags: agreement of two streams, pooled and local thresholds, contributions of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.operators.ranges import sums_before


def quantile(df: DataFrame, column: str, shares: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """Exact, linearly interpolated quantiles: (by..., share, cut).

    Values are counted, the counts of distinct values summed in ranges of values, and the two order statistics next to a
    quantile looked up by their places. So no task holds a group's values, and a group may have any share of all rows. A
    group without values has no row; a null group is one.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    counted = df.where(F.col(column).isNotNull()).groupBy(*(F.col(b).alias(k) for b, k in zip(by, keys)), F.col(column).alias("__v")).agg(F.count("*").alias("__f"))
    placed = sums_before(counted, keys, [F.col("__v")], {"__before": F.col("__f")})
    wanted = F.array(*(F.struct(F.lit(float(s)).alias("share"), ((F.col("__n") - 1) * s).alias("__at")) for s in shares))
    totals = placed.groupBy(*keys).agg(F.sum("__f").alias("__n")).where("__n > 0").select(*(F.col(k).alias(f"{k}_of") for k in keys), F.inline(wanted))
    same = [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys]
    low, high = F.floor("__at"), F.ceil("__at")
    inside = [F.col("__before") <= high, F.col("__before") + F.col("__f") > low]
    near = placed.join(totals, [*same, *inside]) if keys else placed.crossJoin(F.broadcast(totals)).where(inside[0] & inside[1])  # a row for each share
    holds = lambda at: F.max(F.when((F.col("__before") <= at) & (F.col("__before") + F.col("__f") > at), F.col("__v")))
    found = near.groupBy(*keys, "share", "__at").agg(holds(low).alias("__low"), holds(high).alias("__high"))
    cut = F.col("__low") + (F.col("__high") - F.col("__low")) * (F.col("__at") - low)
    return found.select(*(F.col(k).alias(b) for k, b in zip(keys, by)), "share", F.when(F.col("__low") == F.col("__high"), F.col("__low").cast("double")).otherwise(cut).alias("cut"))


def rank_table(df: DataFrame, column: str) -> DataFrame:
    """(value, rank) with ties averaged, from counts of distinct values: only these are sorted, in ranges."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__c"))
    placed = sums_before(counted, [], [F.col(column)], {"__before": F.col("__c")})
    return placed.select(column, (F.col("__before") + (F.col("__c") + 1) / F.lit(2.0)).alias("rank"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: Pearson correlation of average ranks."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = both.join(rank_table(both, a).withColumnRenamed("rank", "ra"), a).join(rank_table(both, b).withColumnRenamed("rank", "rb"), b)
    return ranked.agg(F.corr("ra", "rb").alias("spearman"))


def flag_agreement(pairs: DataFrame, a: str, b: str, percentiles: tuple[int, ...]) -> DataFrame:
    """For each percentile, how far the low flags of a and b agree.

    Flags are value <= cut, ties included; cuts are taken over the pairs. observed = both / max(flagged by a, 1);
    chance is the share that b flags, chance_fixed the nominal one.
    """
    shares = [p / 100 for p in percentiles]
    cuts = quantile(pairs, a, shares).withColumnRenamed("cut", "cut_a").join(quantile(pairs, b, shares).withColumnRenamed("cut", "cut_b"), "share")
    flagged = pairs.crossJoin(F.broadcast(cuts))  # one row for each percentile
    fa, fb = F.col(a) <= F.col("cut_a"), F.col(b) <= F.col("cut_b")
    n = lambda c: F.sum(c.cast("long"))
    counted = flagged.groupBy("share").agg(F.count("*").alias("n"), n(fa).alias("flagged_a"), n(fb).alias("flagged_b"), n(fa & fb).alias("both"), n(fa | fb).alias("either"))
    observed, chance = F.col("both") / F.greatest("flagged_a", F.lit(1)), F.col("flagged_b") / F.col("n")
    return counted.select(
        (F.col("share") * 100).cast("int").alias("pct"),
        "n",
        "flagged_a",
        "flagged_b",
        "both",
        observed.alias("observed"),
        F.col("share").alias("chance_fixed"),
        chance.alias("chance"),
        (observed / chance).alias("ratio"),
        (F.col("both") / F.greatest("either", F.lit(1))).alias("jaccard"),
        ((F.col("flagged_a") - F.col("both")) / F.greatest("flagged_a", F.lit(1))).alias("reclassified"),
    )


def threshold_flags(df: DataFrame, column: str, group: str, percentiles: tuple[int, ...]) -> DataFrame:
    """Rows times percentiles with low_global and low_local: column at most the pooled or the group's own cut."""
    shares = [p / 100 for p in percentiles]
    pooled = quantile(df, column, shares).withColumnRenamed("cut", "cut_global")
    local = quantile(df, column, shares, (group,)).withColumnRenamed("cut", "cut_local")
    joined = df.join(local, group).join(F.broadcast(pooled), "share")
    return joined.withColumns({"pct": (F.col("share") * 100).cast("int"), "low_global": F.col(column) <= F.col("cut_global"), "low_local": F.col(column) <= F.col("cut_local")})


def group_shares(flags: DataFrame, group: str) -> DataFrame:
    """(pct, group, n, flagged, share) of the pooled flag."""
    g = flags.groupBy("pct", group).agg(F.count("*").alias("n"), F.sum(F.col("low_global").cast("long")).alias("flagged"))
    return g.withColumn("share", F.col("flagged") / F.col("n"))


def threshold_agreement(flags: DataFrame, group: str) -> DataFrame:
    """One row per percentile: agreement of pooled and local flags, and the spread of group shares."""
    n = lambda c: F.sum(c.cast("long"))
    a, b = F.col("low_global"), F.col("low_local")
    counted = flags.groupBy("pct").agg(F.count("*").alias("n"), n(a).alias("flagged_global"), n(b).alias("flagged_local"), n(a & b).alias("both"), n(a | b).alias("either"), n(a != b).alias("changed"))
    per = group_shares(flags, group).groupBy("pct").agg(
        F.count("*").alias("groups"),
        F.min("share").alias("share_min"),
        F.percentile("share", F.lit(0.25)).alias("share_q25"),
        F.percentile("share", F.lit(0.5)).alias("share_median"),
        F.percentile("share", F.lit(0.75)).alias("share_q75"),
        F.max("share").alias("share_max"),
        n(F.col("share") < 0.01).alias("groups_under_1pct"),
        n(F.col("share") > 0.5).alias("groups_over_50pct"),
    )
    return counted.join(per, "pct").select("pct", "n", "groups", "flagged_global", "flagged_local", "both", (F.col("both") / F.greatest("either", F.lit(1))).alias("jaccard"), (F.col("changed") / F.col("n")).alias("share_changed"), ((F.col("flagged_global") - F.col("both")) / F.greatest("flagged_global", F.lit(1))).alias("reclassified"), "share_min", "share_q25", "share_median", "share_q75", "share_max", "groups_under_1pct", "groups_over_50pct")


def contributions(shares: DataFrame, group: str, pct: int) -> DataFrame:
    """Groups by what they add to the flagged rows of one percentile, with the running share; ties by name."""
    chosen = shares.where((F.col("pct") == pct) & (F.col("flagged") > 0))
    placed = sums_before(chosen.select(group, "n", "flagged"), [], [F.desc("flagged"), F.col(group)], {"__before": F.col("flagged"), "__row": F.lit(1)})
    total = F.broadcast(chosen.agg(F.sum("flagged").alias("__total")))  # one row
    return placed.crossJoin(total).select(group, "n", "flagged", ((F.col("__before") + F.col("flagged")) / F.col("__total")).alias("cumulative"), (F.col("__row") + 1).cast("int").alias("rank"))


def empirical_percentiles(values: DataFrame, distribution: DataFrame, keys: tuple[str, ...], value: str, name: str = "percentile") -> DataFrame:
    """For each row of values the share of the distribution (same keys) that is strictly below it.

    A merge instead of a product: both sides are counted by value, and running counts meet in one order of ranges, in which
    what is asked for comes before what is equal.
    """
    counted = distribution.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c")).withColumn("__q", F.lit(0))
    asked = values.select(*keys, value).where(F.col(value).isNotNull()).distinct().select(*keys, value, F.lit(0).cast("long").alias("__c"), F.lit(1).alias("__q"))
    both = counted.unionByName(asked)
    placed = sums_before(both, list(keys), [F.col(value), F.desc("__q")], {"__below": F.col("__c")}).where("__q = 1")
    totals = counted.groupBy(*keys).agg(F.sum("__c").alias("__total"))
    ranked = placed.join(totals, list(keys)).select(*keys, value, (F.col("__below") / F.col("__total")).alias(name))
    return values.join(ranked, [*keys, value], "left")
