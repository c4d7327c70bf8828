"""Logistic models of several factors against dense Newton steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.operators import logistic as L
from recordloom.sources import scratch


def dense(x, y, clusters=None):
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ beta))
        h = x.T @ (x * (p * (1 - p))[:, None])
        beta += np.linalg.solve(h, x.T @ (y - p))
    cov = np.linalg.inv(h)
    if clusters is not None:
        names = np.unique(clusters)
        s = np.array([(x * (y - p)[:, None])[clusters == c].sum(axis=0) for c in names])
        (n, k), g = x.shape, len(names)
        cov = cov @ (s.T @ s) @ cov * (g / (g - 1)) * ((n - 1) / (n - k))
    return beta, np.sqrt(np.diag(cov))


def sample(seed, n=900):
    rng = np.random.default_rng(seed)
    a, b, h, z, w = rng.integers(0, 4, n), rng.integers(0, 3, n), rng.integers(0, 12, n), rng.normal(size=n), rng.normal(size=n)
    y = rng.random(n) < 1 / (1 + np.exp(-(-0.7 + 0.8 * (a == 1) - 0.4 * (a == 3) + 0.5 * (b == 2) + 0.3 * z - 0.2 * w + 0.1 * (h % 3))))
    rows = [(f"a{i}", f"b{j}", f"h{k}", float(u), float(v), bool(t)) for i, j, k, u, v, t in zip(a, b, h, z, w, y)]
    return rows, (a, b, h, z, w, y.astype(float))


KINDS = "a string, b string, h string, z double, w double, low boolean"


def told(df):
    return {(r.model, r.factor, r.level): (r.beta, r.se) for r in df.collect()}


@pytest.mark.parametrize("cluster", [None, "h"])
def test_two_factors_and_two_numbers_equal_dense_newton(spark, cluster):
    rows, (a, b, h, z, w, y) = sample(5)
    df = spark.createDataFrame(rows + [("a9", None, "h", 0.0, 0.0, True), (None, "b1", "h", 0.0, 0.0, False), ("a1", "b1", "h1", None, 0.0, True)], KINDS)
    got = told(L.coefficients(df, "low", {"a": "a2", "b": None}, ("z", "w"), cluster=cluster))
    x = np.column_stack([np.ones(len(y)), a == 0, a == 1, a == 3, b == 1, b == 2, z, w]).astype(float)
    beta, se = dense(x, y, h if cluster else None)
    names = [("a", "a0"), ("a", "a1"), ("a", "a3"), ("b", "b1"), ("b", "b2"), ("z", None), ("w", None)]
    assert set(got) == {("all", *n) for n in names}
    for i, n in enumerate(names, 1):
        assert got[("all", *n)] == pytest.approx((beta[i], se[i]), abs=1e-7)


def test_every_model_has_its_own_levels(spark):
    rows, (a, b, h, z, w, y) = sample(7, 2000)
    df = spark.createDataFrame(rows, KINDS).withColumn("m", F.when(F.col("a") < "a2", "low").otherwise("high"))
    found = L.coefficients(df, "low", {"a": None, "b": "b1"}, model="m")
    got = told(found)
    assert {k[1:] for k in got if k[0] == "low"} == {("a", "a1"), ("b", "b0"), ("b", "b2")}
    assert {k[1:] for k in got if k[0] == "high"} == {("a", "a3"), ("b", "b0"), ("b", "b2")}
    own = a >= 2
    beta, se = dense(np.column_stack([np.ones(own.sum()), (a == 3)[own], (b == 0)[own], (b == 2)[own]]).astype(float), y[own])
    assert got["high", "a", "a3"] == pytest.approx((beta[1], se[1]), abs=1e-7)
    assert {r.model: r.n for r in found.collect()} == {"high": own.sum(), "low": (~own).sum()}
    missing = {r.level: r.beta for r in L.coefficients(df, "low", {"a": "a0", "b": "b1"}, model="m").where("model = 'high' and factor = 'a'").collect()}
    assert missing == {"a3": None}  # its reference is in the other model


def test_levels_of_one_outcome_have_no_number_and_change_no_other(spark):
    rows, (a, b, h, z, w, y) = sample(9)
    more = [("a7", "b0", "h1", 0.1, 0.2, False)] * 8 + [("a8", "b7", "h1", 0.1, 0.2, True)] * 3 + [("a0", "b7", "h1", 0.1, 0.2, False)] * 2
    got = {(r.factor, r.level): r for r in L.odds_ratios(spark.createDataFrame(rows + more, KINDS), "low", {"a": "a2", "b": "b0"}).collect()}
    x = np.column_stack([np.ones(len(y)), a == 0, a == 1, a == 3, b == 1, b == 2]).astype(float)
    beta, se = dense(x, y)  # without a8, all rows of b7 have one outcome
    for at, key in enumerate([("a", "a0"), ("a", "a1"), ("a", "a3"), ("b", "b1"), ("b", "b2")], 1):
        r = got.pop(key)
        assert (r.odds_ratio, r.lo, r.hi) == pytest.approx(tuple(np.exp(beta[at] + s * L.Z95 * se[at]) for s in (0, -1, 1)), rel=1e-6)
        assert r.n == len(rows) + len(more) and r.converged
    assert {k: (r.odds_ratio, r.lo, r.hi, r.p) for k, r in got.items()} == {k: (None,) * 4 for k in [("a", "a7"), ("a", "a8"), ("b", "b7")]}


def test_many_models_and_levels_stay_off_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(f"m{i % 40}", f"b{rng.integers(0, 2)}", bool(rng.random() < 0.2 + 0.01 * (i % 40))) for i in range(8000)]
    df = spark.createDataFrame(rows, "m string, a string, low boolean")
    got = {r.model: r.beta for r in L.coefficients(df, "low", {"a": "b0"}, model="m").collect()}
    logit = lambda m, b: (lambda p: np.log(p / (1 - p)))(np.mean([y for k, c, y in rows if (k, c) == (m, b)]))
    assert got == pytest.approx({f"m{i}": logit(f"m{i}", "b1") - logit(f"m{i}", "b0") for i in range(40)}, abs=1e-6)


def test_tables_without_rows_or_without_two_outcomes(spark):
    df = spark.createDataFrame(sample(3, 20)[0], KINDS)
    assert L.coefficients(df.limit(0), "low", {"a": None}).count() == 0
    same = L.coefficients(df.withColumn("low", F.lit(True)), "low", {"a": None}, ("z",)).collect()
    assert {r.level for r in same} == {"a0", "a1", "a2", "a3"} and all(r.beta is None and r.n == 20 for r in same)


def test_scratch_tables_belong_to_their_application(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_folder", lambda _: f"file://{tmp_path}")
    (tmp_path / "recordloom-other-x-1").mkdir()
    assert scratch.materialize(spark.range(3), "x").count() == 3
    assert len(list(tmp_path.iterdir())) == 2
    scratch.drop_tables(spark)
    assert [p.name for p in tmp_path.iterdir() if p.is_dir()] == ["recordloom-other-x-1"]


def test_logit_equals_newton_by_hand(spark):
    rng = np.random.default_rng(5)
    n = 600
    b, z, h = rng.integers(0, 3, n), rng.normal(size=n), rng.integers(0, 12, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(-0.5 + 0.8 * (b == 1) - 0.4 * (b == 2) + 0.3 * z)))).astype(float)
    df = spark.createDataFrame([(f"b{i}", float(v), f"h{k}", bool(t)) for i, v, k, t in zip(b, z, h, y)], "bin string, z double, h string, low boolean")
    x = np.column_stack([np.ones(n), b == 1, b == 2, z]).astype(float)
    for cluster in (None, "h"):
        beta, se = dense(x, y, h if cluster else None)
        got = told(L.coefficients(df, "low", {"bin": "b0"}, ("z",), cluster=cluster))
        for i, key in enumerate([("bin", "b1"), ("bin", "b2"), ("z", None)], 1):
            assert got[("all", *key)] == (pytest.approx(beta[i], abs=1e-8), pytest.approx(se[i], abs=1e-6))


def test_a_factor_may_have_very_many_levels(spark):
    rows = spark.range(4800).select(F.format_string("b%04d", F.col("id") % 1200).alias("bin"), (F.col("id") < 2400).alias("low"))
    got = L.odds_ratios(rows, "low", {"bin": "b0000"}).collect()
    assert len(got) == 1199 and all(r.odds_ratio == pytest.approx(1.0) and r.converged for r in got)
