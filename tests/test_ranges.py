"""Sums along an order, range by range."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.operators import agreement as A
from recordloom.operators import ranges


@pytest.fixture
def many_ranges(spark):
    """Small tables stay in as many ranges as there are shuffle partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("keys", [[], ["k"], ["k", "g"]])
def test_sums_before_equal_a_walk(spark, many_ranges, keys):
    rng = random.Random(len(keys))
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.randrange(2), i, rng.choice([None, 1, 2, 5])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, g int, i long, v long").repartition(5)
    got = ranges.sums_before(df, keys, [F.desc("i")], {"before": F.col("v"), "row": F.lit(1)})
    assert got.columns == ["k", "g", "i", "v", "before", "row"]
    so_far, want = defaultdict(lambda: [0, 0]), {}
    for k, g, i, v in sorted(rows, key=lambda r: -r[2]):
        own = so_far[tuple({"k": k, "g": g}[x] for x in keys)]
        want[i] = tuple(own)
        own[0], own[1] = own[0] + (v or 0), own[1] + 1
    assert {r.i: (r.before, r.row) for r in got.collect()} == want


def test_rows_of_an_empty_table_and_of_doubles(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.25)], "i long, v double")
    assert [tuple(r) for r in ranges.sums_before(df, [], [F.col("i")], {"s": F.col("v")}).orderBy("i").collect()] == [(1, 0.5, 0.0), (2, None, 0.5), (3, 0.25, 0.5)]
    for keys in ([], ["i"]):
        assert ranges.sums_before(df.limit(0), keys, [F.col("i")], {"s": F.col("v")}).count() == 0
    assert sorted((r.i, r.row) for r in ranges.numbered(df, [F.desc("i")]).collect()) == [(1, 2), (2, 1), (3, 0)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_plan_brings_all_rows_to_one_task(spark):
    df = spark.createDataFrame([(f"g{i % 7}", i % 10, i) for i in range(100)], "g string, v int, i long")
    shares = df.groupBy("g").agg(F.count("*").alias("n"), F.sum("v").alias("flagged")).withColumn("pct", F.lit(5))
    assert plan(A.contributions(shares, "g", 5)).count("SinglePartition") == 1  # the total of partial sums
    for found in (A.rank_table(df, "v"), A.empirical_percentiles(df, df, ("g",), "v"), ranges.numbered(df, [F.col("i")])):
        assert "SinglePartition" not in plan(found)


def test_percentiles_are_strictly_below(spark, many_ranges):
    values = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 9.0), ("a", None), ("b", 1.0), ("c", 1.0)], "k string, v double")
    distribution = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 3.0), ("a", None), ("b", 0.5)], "k string, v double")
    got = {(r.k, r.v): r.percentile for r in A.empirical_percentiles(values, distribution, ("k",), "v").collect()}
    assert got == {("a", 1.0): 0.0, ("a", 2.0): 0.25, ("a", 9.0): 1.0, ("a", None): None, ("b", 1.0): 1.0, ("c", 1.0): None}


@pytest.mark.parametrize("block", [4096, 7])
def test_stay_bootstrap_draws_exactly_n(spark, monkeypatch, block):
    from recordloom.operators import resampling as B

    monkeypatch.setattr(B, "BLOCK", block)
    monkeypatch.setattr(B, "DRAWS", 16)
    n, replicates = 60, 12
    rows = [(i, f"u{i}", float(i % 5), None if i % 4 == 0 else 1.0) for i in range(n)] + [(99, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "stay_key long, u string, m double, w double")
    cells = lambda d: {(r.unit, r.replicate, r.metric): (r.n, r.s, r.ss) for r in B.drawn_moments(d, ["m", "w"], "u", replicates, 17).collect() if r.n}
    got = cells(df.repartition(5))
    assert got == cells(df.coalesce(1))
    for b in range(replicates):
        falls = Counter((B.drawn(17, b, np.arange(n), out_of=n) // block).tolist())
        places = [k * block + p for k, m in falls.items() for p in B.drawn(18, k, b, np.arange(m), out_of=min(block, n - k * block)).tolist()]
        weight = Counter(places)
        assert sum(weight.values()) == n
        assert {k[0]: v for k, v in got.items() if k[1:] == (b, "m")} == {f"u{i}": (w, w * float(i % 5), w * float(i % 5) ** 2) for i, w in weight.items()}
        assert {k[0] for k in got if k[1:] == (b, "w")} == {f"u{i}" for i in weight if i % 4}


def test_draws_are_even():
    from recordloom.operators import resampling as B

    counts = np.bincount(B.drawn(17, 3, np.arange(100_000), out_of=50), minlength=50)
    assert abs(counts / 2000 - 1).max() < 0.1
    assert len(set(B.mixed32(np.arange(70_000, dtype=np.uint64)).tolist())) == 70_000
    for n in (1, 2, 11, 5001):
        d = np.sort(B.drawn(4, 9, np.arange(n), out_of=n))
        assert B.middle_draws(4, 9, n) == (d[(n - 1) // 2], d[n // 2])


def test_percentile_bootstrap_equals_rows(spark):
    from recordloom.operators import resampling as B

    rng = np.random.default_rng(3)
    rows = [(f"u{i % 6}", "m", float(v)) for i, v in enumerate(rng.integers(0, 30, 200))] + [("few", "m", 3.0)] * 10 + [("u1", "m", None)]
    values = spark.createDataFrame(rows, "unit string, metric string, value double")
    own = defaultdict(list)
    for u, _, v in rows:
        if v is not None:
            own[u].append(v)
    dist = sorted(float(np.median(v)) for v in own.values())
    got = {r.unit: (r.n, r.lo, r.hi) for r in B.bootstrap_percentile(values, spark.createDataFrame([("m", v) for v in dist], "metric string, value double"), 40, 17).collect()}
    assert got.pop("few") == (10, None, None)
    for u, v in own.items():
        if u != "few":
            medians = [np.median(np.sort(v)[B.drawn(17, b, np.arange(len(v)), out_of=len(v))]) for b in range(40)]
            rank = [np.mean([d < m for d in dist]) for m in medians]
            assert got[u] == (len(v), pytest.approx(np.percentile(rank, 2.5)), pytest.approx(np.percentile(rank, 97.5)))


@pytest.mark.parametrize("by", [(), ("k",), ("k", "g")])
def test_quantiles_equal_sorted_lists(spark, many_ranges, by):
    rng = random.Random(4 + len(by))
    rows = [(rng.choice(["hot"] * 5 + ["a", None]), rng.randrange(2), rng.choice([None, 1.5, 2.0, 7.25, rng.random()])) for _ in range(500)] + [("nothing", 1, None), ("one", 1, 4.0)]
    df = spark.createDataFrame(rows, "k string, g int, v double")
    own = defaultdict(list)
    for k, g, v in rows:
        if v is not None:
            own[tuple({"k": k, "g": g}[b] for b in by)].append(v)
    shares = [0.0, 0.1, 0.5, 1 / 3, 1.0]
    got = {(tuple(r[b] for b in by), r["share"]): r["cut"] for r in A.quantile(df, "v", shares, by).collect()}
    assert got == {(k, s): pytest.approx(np.quantile(v, s), abs=1e-12) for k, v in own.items() for s in shares}
    assert A.quantile(df.limit(0), "v", [0.5], by).count() == 0


def test_quantiles_of_a_group_of_many_distinct_values(spark):
    df = spark.range(0, 2_000_000, 1, 8).select((F.col("id") * 7 % 2_000_003).cast("double").alias("v"))
    want = np.quantile(np.arange(2_000_000) * 7 % 2_000_003, [0.1, 0.5])
    found = A.quantile(df, "v", [0.1, 0.5])
    assert sorted(r.cut for r in found.collect()) == pytest.approx(sorted(want))
    assert "percentile" not in plan(found).lower()


def test_reports_keep_their_order_over_many_files(spark, many_ranges, tmp_path):
    from recordloom.sources import sinks

    df = spark.range(500).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 10).alias("v"))
    sinks.write_report(df, f"file://{tmp_path}/r", "Title", [F.desc("id")])
    files = sorted(p for p in (tmp_path / "r").iterdir() if p.name.startswith("part-"))
    assert len(files) > 2
    lines = "".join(p.read_text() for p in files).split("\n")[:-1]
    want = ["Title", "", "id\tv"] + [f"{i}\t{i % 10 if i % 3 else ''}" for i in range(499, -1, -1)]
    assert lines == want
    assert [r.value for r in sinks.read_report(spark, f"file://{tmp_path}/r").orderBy("place").collect()] == want
    sinks.write_csv(df, f"file://{tmp_path}/c", [F.col("id")])
    again = spark.read.option("header", True).schema("id long, v long").csv(f"file://{tmp_path}/c")
    assert again.count() == 500 and again.where("v is null").count() == 167
