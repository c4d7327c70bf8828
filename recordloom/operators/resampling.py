"""Bootstrap over clusters, stays and units."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.operators import variance as V
from recordloom.operators.agreement import empirical_percentiles
from recordloom.operators.ranges import numbered, sums_before
from recordloom.sources.scratch import materialize

#: Stays of a block, draws made at once, and buckets of a histogram of draws.
BLOCK, DRAWS, BUCKETS = 4096, 1 << 16, 1 << 12


def cluster_weights(clusters: DataFrame, replicates: int, cluster: str = "hospital") -> DataFrame:
    """(replicate, cluster, weight): how often each cluster is drawn with replacement.

    Draw d of replicate b takes the cluster numbered md5(b:d) modulo their number, in name order, so any engine
    draws alike. clusters has one row per cluster; draws are replicates * clusters rows, made on the executors.
    """
    names = numbered(clusters.select(cluster).distinct(), [F.col(cluster)], "i")
    n = names.agg(F.count("*").alias("h"))
    draws = clusters.sparkSession.range(replicates).select(F.col("id").alias("replicate")).crossJoin(F.broadcast(n))
    each = draws.select("replicate", "h", F.explode(F.sequence(F.lit(0), F.col("h").cast("int") - 1)).alias("d"))
    number = F.conv(F.substring(F.md5(F.concat_ws(":", "replicate", "d")), 1, 8), 16, 10).cast("long") % F.col("h")
    return each.groupBy("replicate", number.alias("i")).agg(F.count("*").alias("weight")).join(names, "i").select("replicate", cluster, "weight")


def _density_of_replicates(df: DataFrame, metrics: list[str], covariate: Column, weights: DataFrame, least: int = 10) -> DataFrame:
    """(metric, replicate, given): eta2 over hospitals of the residuals of a straight line on the covariate.

    The line is fitted anew in each replicate. Residuals' sums follow from a hospital's sums and cross-products, so
    these are reweighed; under `least` rows or without spread of the covariate the values themselves are taken.
    """
    cells = V.pair_moments(df, metrics, covariate, "hospital").withColumnRenamed("g", "hospital")
    own = cells.join(weights, "hospital").select("metric", "replicate", "sx", "sy", "n", *[(F.col(c) * F.col("weight")).alias(f"w_{c}") for c in ("n", "sx", "sy", "sxx", "sxy", "syy")])
    sums = own.groupBy("metric", "replicate").agg(*[F.sum(f"w_{c}").alias(f"t_{c}") for c in ("n", "sx", "sy", "sxx", "sxy", "syy")])
    txx, txy, tyy = (F.col(f"t_s{a}{b}") - F.col(f"t_s{a}") * F.col(f"t_s{b}") / F.col("t_n") for a, b in ("xx", "xy", "yy"))
    lines = sums.select("metric", "replicate", "t_n", "t_sx", "t_sy", F.when((F.col("t_n") >= least) & (txx > 0), txy / txx).otherwise(0.0).alias("slope"), txx.alias("txx"), txy.alias("txy"), tyy.alias("tyy"))
    off = F.col("sy") / F.col("n") - F.col("t_sy") / F.col("t_n") - F.col("slope") * (F.col("sx") / F.col("n") - F.col("t_sx") / F.col("t_n"))
    between = own.join(lines, ["metric", "replicate"]).groupBy("metric", "replicate").agg(F.sum(F.col("w_n") * off * off).alias("ssb"))
    sst = F.col("tyy") - 2 * F.col("slope") * F.col("txy") + F.col("slope") ** 2 * F.col("txx")
    # what rounding leaves of a sum of squares that is zero counts as none
    value = F.when((F.col("t_n") >= least) & (sst > 1e-12 * F.col("tyy")), F.col("ssb") / sst)
    return lines.join(between, ["metric", "replicate"]).select("metric", "replicate", value.alias("given"))


def bootstrap_hospital(df: DataFrame, metrics: list[str], replicates: int, density: Column | None = None) -> DataFrame:
    """Percentile intervals of eta2 over hospitals, and of units within them, resampling whole hospitals.

    A cluster drawn k times is a cluster of k times the size with the same mean, so replicates reweigh the moments of
    unit cells; rows are never resampled. With density, also the interval of eta2 over hospitals given density.
    """
    cells = V.metric_moments(df, metrics, ["hospital", "unit_id"])
    drawn = cluster_weights(df.select("hospital"), replicates)
    weighted = cells.join(drawn, "hospital")
    weighted = weighted.select(F.concat_ws("|", "metric", "replicate").alias("metric"), "hospital", "unit_id", (F.col("n") * F.col("weight")).alias("n"), "mean", (F.col("m2") * F.col("weight")).alias("m2"))
    both = V.eta2_of_cells(weighted, F.col("hospital"), "h").join(V.eta2_of_cells(weighted, F.col("unit_id"), "u").drop("n"), "metric")
    each = both.select(F.split_part("metric", F.lit("|"), F.lit(1)).alias("metric"), F.split_part("metric", F.lit("|"), F.lit(2)).cast("long").alias("replicate"), "h", (F.col("u") - F.col("h")).alias("within"))
    cut = lambda c, p: F.percentile(c, F.lit(p))
    wanted = [cut("h", 0.025).alias("hospital_lo"), cut("h", 0.975).alias("hospital_hi"), cut("within", 0.025).alias("within_lo"), cut("within", 0.975).alias("within_hi")]
    if density is not None:
        each = each.join(_density_of_replicates(df, metrics, density, drawn), ["metric", "replicate"], "left")
        wanted += [cut("given", 0.025).alias("given_density_lo"), cut("given", 0.975).alias("given_density_hi")]
    return each.groupBy("metric").agg(F.count("*").alias("replicates"), *wanted)


_M32 = np.uint64((1 << 32) - 1)


def mixed32(x: np.ndarray) -> np.ndarray:
    """The finalizer of MurmurHash3 on 32-bit numbers: a bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(16))
    x = x * np.uint64(0x85EBCA6B) & _M32
    x = x ^ (x >> np.uint64(13))
    x = x * np.uint64(0xC2B2AE35) & _M32
    return x ^ (x >> np.uint64(16))


def drawn(seed: int, *parts: np.ndarray | int, out_of: int) -> np.ndarray:
    """A number below out_of for each combination of parts, the same in any engine: hashes of all parts, scaled."""
    h = mixed32(np.array([seed], np.uint64))
    for part in parts:
        h = mixed32(h ^ np.asarray(part, np.uint64))
    return (h * np.uint64(out_of) >> np.uint64(32)).astype(np.int64)


def _falls(seed: int, n: int):
    """From (replicate, first, last) to (replicate, block, drawn): in which blocks these draws of a replicate fall."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                block, times = np.unique(drawn(seed, r["replicate"], np.arange(r["first"], r["last"]), out_of=n) // BLOCK, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(block), r["replicate"])), pa.array(block), pa.array(times)], names=["replicate", "block", "drawn"])

    return run


def _weighed(seed: int, metrics: list[str]):
    """From a block's stays and its numbers of draws to the moments of each unit in each replicate."""

    def run(stays: pa.Table, falls: pa.Table) -> pa.Table:
        replicate, times = falls.column("replicate").to_numpy(), falls.column("drawn").to_numpy()
        size, block = stays.num_rows, stays.column("block")[0].as_py() if stays.num_rows else 0
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        place = drawn(seed + 1, block, np.repeat(replicate, times), nth, out_of=size)
        weight = np.bincount(np.repeat(np.arange(len(times)), times) * size + place, minlength=len(times) * size).reshape(len(times), size).astype(float)
        order = np.argsort(stays.column("place").to_numpy())
        units = np.array(stays.column("unit").to_pylist(), object)[order]
        values = np.stack([stays.column(f"m{i}").to_numpy()[order].astype(float) for i in range(len(metrics))], axis=1)
        there = ~np.isnan(values)
        filled = np.where(there, values, 0.0)
        names, owner = np.unique(units.astype(str), return_inverse=True)
        out = {k: [] for k in ("unit", "replicate", "metric", "n", "s", "ss")}
        r, m = np.meshgrid(replicate, np.arange(len(metrics)), indexing="ij")
        for u, name in enumerate(names):
            rows = owner == u
            w = weight[:, rows]
            part = w @ there[rows], w @ filled[rows], w @ (filled[rows] ** 2)
            for k, v in zip(out, (np.full(r.size, name, object), r.ravel(), np.array(metrics, object)[m.ravel()], *(p.ravel() for p in part))):
                out[k].append(v)
        kinds = pa.string(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.float64()
        return pa.table({k: pa.array(np.concatenate(v), t) for (k, v), t in zip(out.items(), kinds)})

    return run


def drawn_moments(df: DataFrame, metrics: list[str], unit: str, replicates: int, seed: int, key: str = "stay_key") -> DataFrame:
    """(unit, replicate, metric, n, s, ss): count, sum and sum of squares of the stays drawn, in parts that add up.

    Draws of a replicate, as many as there are stays, first fall into blocks of BLOCK stays by key, in proportion to
    their sizes, which only needs counts; where a block's draws fall among its stays is told where the block is.
    """
    spark = df.sparkSession
    flat = df.where(F.col(unit).isNotNull()).select(F.col(key).alias("key"), F.col(unit).cast("string").alias("unit"), *[F.col(m).cast("double").alias(f"m{i}") for i, m in enumerate(metrics)])
    placed = materialize(numbered(flat, [F.col("key"), F.col("unit"), *(F.col(f"m{i}") for i in range(len(metrics)))]), "numbered")
    n = placed.count()
    if n >= 1 << 32:
        raise ValueError("at most 2^32 stays can be drawn from")
    tasks = spark.range(replicates).select(F.col("id").alias("replicate"), F.explode(F.sequence(F.lit(0), F.lit(n), F.lit(DRAWS))).alias("first"))
    tasks = tasks.withColumn("last", F.least(F.col("first") + DRAWS, F.lit(n))).where("first < last").repartition("replicate", "first")
    falls = tasks.mapInArrow(_falls(seed, n), "replicate long, block long, drawn long").groupBy("replicate", "block").agg(F.sum("drawn").alias("drawn"))
    blocks = placed.withColumns({"block": F.floor(F.col("row") / BLOCK), "place": F.col("row") % BLOCK}).drop("row", "key")
    return blocks.groupBy("block").cogroup(falls.groupBy("block")).applyInArrow(_weighed(seed, metrics), "unit string, replicate long, metric string, n double, s double, ss double")


def bootstrap_stays(df: DataFrame, metrics: list[str], unit: str, replicates: int, seed: int, key: str = "stay_key") -> DataFrame:
    """Percentile intervals of eta2 over units, resampling stays: exactly as many draws as there are stays, in any partitioning.

    Draws come from hashes of replicate and draw, so that any engine draws alike. Stays with a null unit are left out,
    those with a null key come first. At most 2^32 stays.
    """
    parts = drawn_moments(df, metrics, unit, replicates, seed, key)
    cells = parts.groupBy(F.concat_ws("|", "metric", "replicate").alias("metric"), "unit").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).where("n > 0")
    moments = cells.select("metric", "unit", "n", (F.col("s") / F.col("n")).alias("mean"), F.greatest(F.lit(0.0), F.col("ss") - F.col("s") ** 2 / F.col("n")).alias("m2"))
    each = V.eta2_of_cells(moments, F.col("unit")).select(F.split_part("metric", F.lit("|"), F.lit(1)).alias("metric"), "eta2")
    return each.groupBy("metric").agg(F.count("*").alias("replicates"), F.percentile("eta2", F.lit(0.025)).alias("lo"), F.percentile("eta2", F.lit(0.975)).alias("hi"))


def middle_draws(seed: int, replicate: int, n: int) -> tuple[int, int]:
    """The two middle ones of n sorted draws below n, found in two passes that keep a histogram and one or two of its buckets."""
    low, high = (n - 1) // 2, n // 2
    passes = lambda: (drawn(seed, replicate, np.arange(at, min(n, at + DRAWS)), out_of=n) for at in range(0, n, DRAWS))
    counts = np.zeros(BUCKETS, np.int64)
    for d in passes():
        counts += np.bincount(d * BUCKETS // n, minlength=BUCKETS)
    upto = np.cumsum(counts)
    first, last = np.searchsorted(upto, [low, high], "right")
    near = np.sort(np.concatenate([d[(b >= first) & (b <= last)] for d in passes() for b in (d * BUCKETS // n,)]))
    before = upto[first] - counts[first]
    return int(near[low - before]), int(near[high - before])


def _middles(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                low, high = middle_draws(seed, r["replicate"], r["n"])
                yield pa.RecordBatch.from_pydict({"n": [r["n"]], "replicate": [r["replicate"]], "low": [low], "high": [high]})

    return run


def bootstrap_percentile(values: DataFrame, distribution: DataFrame, replicates: int, seed: int, least: int = 11) -> DataFrame:
    """(unit, metric, n, lo, hi): interval of the percentile rank of a unit's median among unit medians.

    values: (unit, metric, value) of stays; distribution: (metric, value), one row per unit. A replicate draws n of a unit's
    n values; as a drawn value only counts by its place in their order, the draws of all units of one size are the same,
    as from one seed, and of a replicate only the two middle ones are needed. Those are looked up among the unit's values in
    order, and replicate medians are merged with the unit medians. lo and hi are null under `least` values; null values
    don't count.
    """
    spark = values.sparkSession
    there = values.where("value is not null").select("unit", "metric", "value")
    sizes = materialize(there.groupBy("unit", "metric").agg(F.count("*").alias("n")), "sizes")
    asked = sizes.where(F.col("n") >= least).select("n").distinct().crossJoin(spark.range(replicates).withColumnRenamed("id", "replicate"))  # replicates is a parameter
    middles = asked.repartition("n", "replicate").mapInArrow(_middles(seed), "n long, replicate long, low long, high long")
    wanted = sizes.join(materialize(middles, "middles"), "n").select("unit", "metric", "replicate", F.explode(F.array("low", "high")).alias("row"))
    placed = sums_before(there, ["unit", "metric"], [F.col("value")], {"row": F.lit(1).cast("long")})
    medians = materialize(wanted.join(placed, ["unit", "metric", "row"]).groupBy("unit", "metric", "replicate").agg(F.avg("value").alias("value")), "medians")
    ranks = empirical_percentiles(medians, distribution, ("metric",), "value", "rank")
    bounds = ranks.groupBy("unit", "metric").agg(F.percentile("rank", F.lit(0.025)).alias("lo"), F.percentile("rank", F.lit(0.975)).alias("hi"))
    return sizes.join(bounds, ["unit", "metric"], "left").select("unit", "metric", "n", "lo", "hi")
