"""Hand-computed fixtures for the study's operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.functions import scalars as S
from recordloom.operators import agreement as A
from recordloom.operators import events as E
from recordloom.operators import mixed as X
from recordloom.operators import resampling as B
from recordloom.operators import variance as V


def one(df):
    return df.collect()[0]


def events(spark, *offsets):
    return spark.createDataFrame([(1, o) for o in offsets], "stay_key long, offset_min int")


def test_single_record_has_null_gaps(spark):
    r = one(E.stay_metrics(events(spark, 30)))
    assert (r.n_records, r.t_first_h) == (1, 0.5)
    assert r.median_interval_min is None and r.n_gaps_gt30m is None and r.frac_time_in_gaps is None


def test_equal_offsets_are_kept(spark):
    r = one(E.stay_metrics(events(spark, 10, 10, 70)))
    assert (r.n_records, r.median_interval_min, r.max_interval_min, r.n_gaps_gt30m) == (3, 30.0, 60.0, 1)


def test_window_is_half_open(spark):
    kept = [r.offset_min for r in E.in_window(events(spark, -1, 0, 1439, 1440)).collect()]
    assert sorted(kept) == [0, 1439]


def test_gaps_of_exactly_two_hours_are_not_over(spark):
    r = one(E.stay_metrics(events(spark, 0, 120, 240)))
    assert r.n_gaps_gt2h == 0 and r.frac_time_in_gaps == 0


def test_low_flags_include_ties(spark):
    df = spark.createDataFrame([(i, "g", n) for i, n in enumerate([1, 2, 2, 2, 9])], "id int, g string, n int")
    flags = A.threshold_flags(df, "n", "g", (50,))
    assert one(flags.agg(F.avg(F.col("low_global").cast("int")).alias("m"))).m == pytest.approx(0.8)


def test_lenient_numbers(spark):
    texts = ["98.6", " 12 ", "1e2", "12d", "NaN", "", "abc", ".5", "5.", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.v for r in df.select("i", S.lenient_numeric(F.col("t")).alias("v")).orderBy("i").collect()]
    assert got == [98.6, 12.0, 100.0, None, None, None, None, 0.5, 5.0, None]


def test_worst_value_ties_go_high(spark):
    df = spark.createDataFrame([(36.5, 38.4), (35.0, 38.0), (36.0, 38.0)], "lo double, hi double")
    got = [r[0] for r in df.select(S.tail_value(F.col("lo"), F.col("hi"), "both", 37.0)).collect()]
    assert got == [38.4, 35.0, 38.0]


def test_constant_metric_has_no_eta2(spark):
    df = spark.createDataFrame([("a" if i % 2 else "b", 5.0) for i in range(20)], "g string, m double")
    assert one(V.eta2(df, ["m"], "g")).eta2 is None


def test_eta2_keeps_null_groups_in_the_total(spark):
    rng = np.random.default_rng(1)
    y, g = rng.normal(size=60), rng.integers(0, 4, 60)
    df = spark.createDataFrame([(None if k == 3 else f"g{k}", float(v)) for k, v in zip(g, y)], "g string, m double")
    grand = y.mean()
    ssb = sum((g == k).sum() * (y[g == k].mean() - grand) ** 2 for k in range(3))
    assert one(V.eta2(df, ["m"], "g")).eta2 == pytest.approx(ssb / ((y - grand) ** 2).sum(), abs=1e-12)


def test_partial_eta2_equals_least_squares(spark):
    rng = np.random.default_rng(2)
    n = 400
    g, x = rng.integers(0, 9, n), rng.normal(size=n)
    y = 0.4 * x + 0.3 * g + rng.normal(size=n)
    df = spark.createDataFrame([(f"g{k}", float(a), float(b)) for k, a, b in zip(g, x, y)], "g string, x double, m double")

    def r2(design):
        res = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
        return 1 - (res**2).sum() / ((y - y.mean()) ** 2).sum()

    base = r2(np.column_stack([np.ones(n), x]))
    full = r2(np.column_stack([x] + [(g == k).astype(float) for k in range(9)]))
    assert one(V.partial_eta2(df, ["m"], F.col("x"), "g")).partial_eta2 == pytest.approx((full - base) / (1 - base), abs=1e-10)


def test_bootstrap_on_moments_equals_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(f"h{h}", f"h{h}:u{u}", float(rng.normal(h, 1))) for h in range(6) for u in range(2) for _ in range(12)]
    df = spark.createDataFrame(rows, "hospital string, unit_id string, m double")
    weights = {}
    for r in B.cluster_weights(df.select("hospital"), 20).collect():
        weights.setdefault(r.replicate, {})[r.hospital] = r.weight
    found = []
    for w in weights.values():
        assert sum(w.values()) == 6
        y = np.array([v for h, _, v in rows for _ in range(w.get(h, 0))])
        g = np.array([h for h, _, _ in rows for _ in range(w.get(h, 0))])
        found.append(sum((g == k).sum() * (y[g == k].mean() - y.mean()) ** 2 for k in set(g)) / ((y - y.mean()) ** 2).sum())
    got = one(B.bootstrap_hospital(df, ["m"], 20))
    assert got.hospital_lo == pytest.approx(np.percentile(found, 2.5), abs=1e-9)
    assert got.hospital_hi == pytest.approx(np.percentile(found, 97.5), abs=1e-9)


def test_bootstrap_given_density_equals_rows(spark):
    rng = np.random.default_rng(8)
    rows = []
    for h in range(6):
        for u in range(2):
            for _ in range(12):
                n = int(rng.integers(3, 40))
                rows.append((f"h{h}", f"h{h}:u{u}", n, None if rng.random() < 0.1 else float(rng.normal(h, 1) + 0.2 * n)))
    df = spark.createDataFrame(rows, "hospital string, unit_id string, n_records int, m double")
    weights = {}
    for r in B.cluster_weights(df.select("hospital"), 20).collect():
        weights.setdefault(r.replicate, {})[r.hospital] = r.weight
    found = []
    for w in weights.values():
        drawn = [(h, np.log(n), v) for h, _, n, v in rows for _ in range(w.get(h, 0)) if v is not None]
        g, x, y = (np.array(c) for c in zip(*drawn))
        y = y - np.polyval(np.polyfit(x, y, 1), x)
        found.append(sum((g == k).sum() * (y[g == k].mean() - y.mean()) ** 2 for k in set(g)) / ((y - y.mean()) ** 2).sum())
    got = one(B.bootstrap_hospital(df, ["m"], 20, F.log("n_records")))
    assert got.given_density_lo == pytest.approx(np.percentile(found, 2.5), abs=1e-9)
    assert got.given_density_hi == pytest.approx(np.percentile(found, 97.5), abs=1e-9)
    plain = one(B.bootstrap_hospital(df, ["m"], 20))
    assert (got.hospital_lo, got.within_hi) == pytest.approx((plain.hospital_lo, plain.within_hi), abs=1e-12)


def test_bootstrap_queries_run_the_whole_job(spark):
    from recordloom.plans.catalog import QUERIES

    eight = {"n_records", "t_first_h", "median_interval_min", "iqr_interval_min", "max_interval_min", "n_gaps_gt30m", "n_gaps_gt2h", "frac_time_in_gaps"}
    for name, bounds in (("bootstrap_stay", ("lo",)), ("bootstrap_decomposition", ("hospital_lo", "within_lo", "given_density_lo"))):
        got = {r.metric: r for r in QUERIES[name](spark, "/root/testdata/sf0.001").collect()}
        assert set(got) == eight and {r.replicates for r in got.values()} == {500}
        assert all(got["median_interval_min"][b] is not None for b in bounds)


def test_stay_bootstrap_brackets_the_estimate(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, f"u{i % 4}", float(rng.normal(i % 4, 2))) for i in range(400)], "stay_key long, u string, m double")
    point = one(V.eta2(df, ["m"], "u")).eta2
    got = one(B.bootstrap_stays(df, ["m"], "u", 100, 17))
    assert got.lo < point < got.hi and got.hi - got.lo < 0.3
    assert one(B.bootstrap_stays(df.repartition(3), ["m"], "u", 100, 17)).lo == pytest.approx(got.lo, abs=1e-9)


def test_unknown_tails_raise():
    with pytest.raises(ValueError):
        S.tail_value(None, None, "middle")
    with pytest.raises(ValueError):
        S.tail_value(None, None, "both")


def test_hourly_models_have_four_specifications(spark):
    from recordloom.plans import study
    from recordloom.plans.catalog import QUERIES
    from recordloom.sources.tables import Star

    sf = "/root/testdata/sf0.01"
    star = Star(spark, sf)
    rows = study._specifications(star).select("specification", "stay_key", "records", "low").toPandas()
    done = {r.stay_key for r in star.stays().where("completed").select("stay_key").collect()}
    subsets = {}
    for exposure, events in (("contaminated", star.monitor()), ("clean", star.nurse())):
        counts = {r.stay_key: r["count"] for r in E.in_window(events).groupBy("stay_key").count().collect()}
        for restriction in ("all stays", "completed 24h"):
            own = rows[rows.specification == f"{exposure} / {restriction}"]
            assert len(own) and own.stay_key.is_unique
            assert [counts[k] for k in own.stay_key] == own.records.tolist()
            assert (own.low == (own.records <= own.records.quantile(0.10))).all()
            subsets[exposure, restriction] = set(own.stay_key)
        assert subsets[exposure, "completed 24h"] == subsets[exposure, "all stays"] & done != subsets[exposure, "all stays"]
    assert subsets["clean", "all stays"] == subsets["contaminated", "all stays"]
    got = QUERIES["logit_hourly"](spark, sf).groupBy("model").agg(F.first("n").alias("n")).collect()
    assert {r.model: r.n for r in got} == rows.groupby("specification").size().to_dict()


def test_mixed_criterion_equals_dense(spark):
    rng = np.random.default_rng(6)
    hospital = np.repeat(np.arange(6), 20)
    unit = np.tile(np.arange(3), 40) + 3 * hospital
    y = rng.normal(size=6)[hospital] + 0.5 * rng.normal(size=18)[unit] + rng.normal(size=120)
    n = np.bincount(unit)
    mean = np.bincount(unit, y) / n
    ssw = ((y - mean[unit]) ** 2).sum()
    zh, zu = np.eye(6)[hospital], np.eye(18)[unit]

    def dense(lh, lu):
        v = np.eye(120) + lh * zh @ zh.T + lu * zu @ zu.T
        vi = np.linalg.inv(v)
        one_ = np.ones(120)
        mu = one_ @ vi @ y / (one_ @ vi @ one_)
        q = (y - mu) @ vi @ (y - mu)
        return 119 * np.log(q) + np.linalg.slogdet(v)[1] + np.log(one_ @ vi @ one_)

    points = [(0.5, 0.2), (2.0, 0.01), (0.05, 1.0)]
    cells = spark.createDataFrame([("m", f"h{i // 3}", float(n[i]), float(mean[i])) for i in range(18)], "metric string, hospital string, n double, mean double")
    got = X.criteria(cells, {"m": (120.0, ssw)}, {"m": np.log(points)})["m"]
    assert got == pytest.approx([dense(lh, lu) for lh, lu in points], abs=1e-7)
    df = spark.createDataFrame([(f"h{a}", f"u{b}", float(v)) for a, b, v in zip(hospital, unit, y)], "hospital string, unit_id string, m double")
    r = one(X.mixed_vpc(df, ["m"]))
    assert r.converged and 0 <= r.vpc_unit <= 1 and 0 <= r.vpc_hospital <= 1
    ratios = np.array([r.vpc_hospital, r.vpc_unit]) / (1 - r.vpc_hospital - r.vpc_unit)
    here = dense(*ratios)  # the criterion doesn't depend on the scale of y
    assert all(here <= dense(*(ratios * np.exp(step))) for step in ([0.01, 0], [-0.01, 0], [0, 0.01], [0, -0.01], [3, 3], [-3, 3], [3, -3], [-3, -3]))


def test_mixed_has_no_bound_on_units_and_null_shares_without_variance(spark):
    df = spark.createDataFrame([("h", f"u{i}", float(i), 1.0, None) for i in range(4)], "hospital string, unit_id string, m double, k double, e double")
    got = {r.metric: r for r in X.mixed_vpc(df, ["m", "k", "e"]).collect()}
    assert got["m"].units == 4 and got["e"].n == 0 and all(r.vpc_unit is None and not r.converged for r in got.values())
    many = spark.range(6000).select(F.concat(F.lit("h"), F.col("id") % 40).alias("hospital"), F.concat(F.lit("u"), F.col("id") % 2000).alias("unit_id"), (F.col("id") % 40 + F.hash("id") % 30).cast("double").alias("m"))
    r = one(X.mixed_vpc(many, ["m"]))
    assert (r.n, r.hospitals, r.units) == (6000, 40, 2000) and r.converged and r.vpc_hospital > 0.2


def test_severity_cleanup_of_a_whole_table_equals_sql(spark):
    import duckdb

    from recordloom.plans.catalog import ORACLE_SQL, QUERIES

    sf, name = "/root/testdata/sf0.01", "severity_cleanup_table"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{sf}/customer.parquet'")
    want = sorted(con.sql(ORACLE_SQL[name]).fetchall())
    got = sorted(tuple(r) for r in QUERIES[name](spark, sf).collect())
    assert len(got) == len(want) == 1500
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=1e-9)


def test_strict_percentile(spark):
    dist = spark.createDataFrame([("m", float(v)) for v in (1, 2, 2, 3)], "metric string, value double")
    values = spark.createDataFrame([("m", 2.0), ("m", 9.0), ("m", 0.5)], "metric string, value double")
    got = {r.value: r.percentile for r in A.empirical_percentiles(values, dist, ("metric",), "value").collect()}
    assert got == {2.0: 0.25, 9.0: 1.0, 0.5: 0.0}


def test_spearman_averages_ties(spark):
    df = spark.createDataFrame([(1, 2), (2, 2), (2, 5), (4, 7)], "a int, b int")
    ra, rb = np.array([1, 2.5, 2.5, 4]), np.array([1.5, 1.5, 3, 4])
    assert one(A.spearman(df, "a", "b")).spearman == pytest.approx(np.corrcoef(ra, rb)[0, 1])


def test_float_offsets_of_the_reference_mode(spark):
    df = spark.sql("select timestamp_ntz'2020-01-01 00:00:00' a, timestamp_ntz'2020-01-01 02:00:00' b")
    r = one(df.select(S.elapsed_minutes(F.col("a"), F.col("b")).alias("x"), S.elapsed_minutes(F.col("a"), F.col("b"), exact=False).alias("y")))
    assert r.x == 120.0 and r.y == pytest.approx(120.0)
