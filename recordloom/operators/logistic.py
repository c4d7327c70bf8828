"""Logistic models of several factors and numbers, fitted by iteratively reweighted least squares.

Rows keep the codes of their levels; no dense design is built. A step computes each row's linear predictor, sums the
products of the few entries that are not zero by pairs of coefficients, and solves each model's k x k system in a task
that has that model's sums alone. All models take a step in one job, and a model that has converged leaves. Levels,
sums and coefficients stay in tables; the driver only asks whether any model is left.

A level whose rows all have one outcome has no finite coefficient. Its rows say nothing about the other coefficients in
the limit, so they are left out of the fit, again until no such level is left, and the level is reported without numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from recordloom.sources.scratch import materialize

#: Half-width of a 95 % interval in standard errors.
Z95 = 1.959963984540054
_STATE = "model string, beta array<double>, loglik double, done boolean"
_FOUND = "model string, at int, beta double, se double, p double, converged boolean"


def _levels(rows: DataFrame, factors: int) -> DataFrame:
    """(model, factor, level, n, y) of each level of each factor."""
    each = F.array(*(F.struct(F.lit(i).alias("factor"), F.col(f"f{i}").alias("level")) for i in range(factors)))
    return rows.select("model", "y", F.inline(each)).groupBy("model", "factor", "level").agg(F.count("*").alias("n"), F.sum("y").alias("y"))


def without_separated(rows: DataFrame, factors: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows left, their levels, the levels taken out): no level left has one outcome only."""
    gone = None
    while True:
        levels = materialize(_levels(rows, factors), "levels")
        single = levels.where("y = 0 or y = n").select("model", "factor", "level")
        if single.isEmpty():
            return rows, levels, single if gone is None else gone
        gone = single if gone is None else gone.unionByName(single)
        for i in range(factors):
            rows = rows.join(single.where(f"factor = {i}").select("model", F.col("level").alias(f"f{i}")), ["model", f"f{i}"], "left_anti")


def _coded(levels: DataFrame, references: list[str | None], numbers: int) -> DataFrame:
    """(model, factor, level, base, at): the coefficient of each level, none for the base: the reference, else the smallest level."""
    wanted = reduce(lambda c, i: c.when(F.col("factor") == i, F.lit(references[i])), range(len(references)), F.when(F.lit(False), F.lit(None).cast("string")))
    base = levels.groupBy("model", "factor").agg(F.coalesce(F.max(F.when(F.col("level") == wanted, F.col("level"))), F.min("level")).alias("base"))
    joined = levels.join(base, ["model", "factor"])
    inner = joined.where("level <> base").withColumn("at", F.row_number().over(Window.partitionBy("model").orderBy("factor", "level")) + numbers)
    return inner.select("model", "factor", "level", "base", "at").unionByName(joined.where("level = base").select("model", "factor", "level", "base", F.lit(None).cast("int").alias("at")))


def _predicted(coded: DataFrame, state: DataFrame, factors: int, numbers: int) -> DataFrame:
    """coded with the linear predictor eta, p and the residual r under each model's coefficients."""
    parts = ["get(beta, 0)", *(f"x{j} * get(beta, {j + 1})" for j in range(numbers)), *(f"coalesce(get(beta, c{i}), 0D)" for i in range(factors))]
    with_eta = coded.join(state.select("model", "beta"), "model").selectExpr(*coded.columns, f"{' + '.join(parts)} as eta")
    return with_eta.selectExpr("*", "1 / (1 + exp(-eta)) as p").selectExpr("*", "y - n * p as r")


def _entries(factors: int, numbers: int) -> list[tuple[str, str]]:
    """(coefficient, value) of what is not zero in a row, by ascending coefficient."""
    return [("0", "1D"), *((f"{j + 1}", f"x{j}") for j in range(numbers)), *((f"c{i}", "1D") for i in range(factors))]


def _sums(predicted: DataFrame, entries: list[tuple[str, str]], slopes: bool = True) -> DataFrame:
    """(model, i, j, v): X'WX for i <= j and, with slopes, X'r at j = -1 and the log-likelihood at i = j = -1."""
    found = [(i, j, f"n * p * (1 - p) * {a} * {b}") for at, (i, a) in enumerate(entries) for j, b in entries[at:]]
    if slopes:
        found += [(i, "-1", f"r * {a}") for i, a in entries]
        found.append(("-1", "-1", "y * eta - n * (greatest(eta, 0D) + log1p(exp(-abs(eta))))"))
    told = ", ".join(f"struct(int({i}) as i, int({j}) as j, double({v}) as v)" for i, j, v in found)
    each = predicted.selectExpr("model", f"inline(array({told}))").where("i is not null and j is not null")
    return each.groupBy("model", "i", "j").agg(F.sum("v").alias("v"))


def _by_model(sums: DataFrame, name: str) -> DataFrame:
    return sums.groupBy("model").agg(F.collect_list(F.struct("i", "j", "v")).alias(name))


def _system(entries: list[dict], k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """X'WX, X'r and the log-likelihood."""
    h, g, loglik = np.zeros((k, k)), np.zeros(k), 0.0
    for e in entries:
        if e["i"] < 0:
            loglik = e["v"]
        elif e["j"] < 0:
            g[e["i"]] = e["v"]
        else:
            h[e["i"], e["j"]] = h[e["j"], e["i"]] = e["v"]
    return h, g, loglik


def _newton(tolerance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                beta = np.array(r["beta"])
                h, g, loglik = _system(r["sums"], len(beta))
                beta += np.clip(np.linalg.pinv(h, hermitian=True) @ g, -5, 5)
                done = r["loglik"] is not None and abs(loglik - r["loglik"]) < tolerance * (abs(loglik) + 0.1)
                out.append({"model": r["model"], "beta": beta.tolist(), "loglik": loglik, "done": done})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("model", pa.string()), ("beta", pa.list_(pa.float64())), ("loglik", pa.float64()), ("done", pa.bool_())]))

    return run


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Standard errors from the inverse of X'WX, or around the meat of clusters."""
    kinds = pa.schema([("model", pa.string()), ("at", pa.int32()), ("beta", pa.float64()), ("se", pa.float64()), ("p", pa.float64()), ("converged", pa.bool_())])
    for batch in batches:
        for r in batch.to_pylist():
            k = len(r["beta"])
            cov = np.linalg.pinv(_system(r["sums"], k)[0], hermitian=True)
            if r["clusters"] is not None:
                meat, g = np.zeros((k, k)), r["clusters"]
                for e in r["meat"]:
                    meat[e["i"], e["j"]] = e["v"]
                cov = cov @ meat @ cov * (g / max(1, g - 1)) * (r["n"] - 1) / max(1, r["n"] - k)
            se = np.sqrt(np.maximum(np.diag(cov), 0.0))
            p = [math.erfc(abs(b / s) / math.sqrt(2)) if s else None for b, s in zip(r["beta"], se.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([r["model"]] * k), pa.array(range(k), pa.int32()), pa.array(r["beta"], pa.float64()), pa.array(se), pa.array(p, pa.float64()), pa.array([r["done"]] * k)], schema=kinds)


def _meat(predicted: DataFrame, entries: list[tuple[str, str]]) -> DataFrame:
    """(model, meat, clusters): sums over clusters of products of their score sums. A cluster has k sums at most."""
    score = ", ".join(f"struct(int({i}) as i, double(r * {a}) as v)" for i, a in entries)
    scores = predicted.selectExpr("model", "cluster", f"inline(array({score}))").where("i is not null").groupBy("model", "cluster", "i").agg(F.sum("v").alias("v"))
    own = scores.groupBy("model", "cluster").agg(F.collect_list(F.struct("i", "v")).alias("s"))
    products = "flatten(transform(s, a -> transform(s, b -> struct(a.i as i, b.i as j, a.v * b.v as v))))"
    sums = own.selectExpr("model", f"inline({products})").groupBy("model", "i", "j").agg(F.sum("v").alias("v"))
    return _by_model(sums, "meat").join(own.groupBy("model").agg(F.count("*").alias("clusters")), "model")


def coefficients(df: DataFrame, flag: str, factors: dict[str, str | None], numbers: tuple[str, ...] = (), *, cluster: str | None = None, model: str | None = None, steps: int = 25, tolerance: float = 1e-9) -> DataFrame:
    """(model, factor, level, n, beta, se, p, converged) of flag on factors and numbers, for each value of model.

    factors names each factor's reference level; None takes the smallest one of the model. Rows with a null in any of these
    columns are left out, and n counts the others. With cluster, errors are robust to clusters, with the factor
    G / (G - 1) * (n - 1) / (n - k). A number has a null level; references have no row.

    beta, se and p are null for levels whose rows all have one outcome, and for all levels of a factor whose given
    reference is missing or such a level. A null model is a model of its own, named null. Without rows there is none.
    """
    names, references = list(factors), list(factors.values())
    f, c = len(names), len(numbers)
    parts = [F.coalesce(F.col(model).cast("string"), F.lit("null")) if model else F.lit("all"), F.col(flag).cast("double"), F.coalesce(F.col(cluster).cast("string"), F.lit("")) if cluster else F.lit("")]
    labels = ["model", "y", "cluster"]
    chosen = df.select(*(x.alias(n) for x, n in zip(parts, labels)), *(F.col(n).cast("string").alias(f"f{i}") for i, n in enumerate(names)), *(F.col(n).cast("double").alias(f"x{j}") for j, n in enumerate(numbers)))
    rows = materialize(chosen.dropna(), "design")
    totals = rows.groupBy("model").agg(F.count("*").alias("n"))
    left, levels, gone = without_separated(rows, f)
    codes = materialize(_coded(levels, references, c), "codes")
    for i in range(f):
        left = left.join(codes.where(f"factor = {i}").select("model", F.col("level").alias(f"f{i}"), F.col("at").alias(f"c{i}")), ["model", f"f{i}"]).drop(f"f{i}")
    keys = ["model", "cluster", *(f"c{i}" for i in range(f))]
    if c:
        coded = left.select(*keys, *(f"x{j}" for j in range(c)), "y", F.lit(1).cast("long").alias("n"))
    else:  # rows of equal codes count as one
        coded = left.groupBy(*keys).agg(F.sum("y").alias("y"), F.count("*").alias("n"))
    coded = materialize(coded, "coded")

    width = coded.select("model").distinct().join(codes.groupBy("model").agg(F.max("at").alias("most")), "model", "left")
    active = width.select("model", F.array_repeat(F.lit(0.0), F.coalesce("most", F.lit(c)) + 1).alias("beta"), F.lit(None).cast("double").alias("loglik"), F.lit(False).alias("done"))
    entries, finished = _entries(f, c), []
    for _ in range(steps):
        left_over = Observation()
        sums = _by_model(_sums(_predicted(coded, active, f, c), entries), "sums")
        moved = sums.join(active, "model").mapInArrow(_newton(tolerance), _STATE)
        after = materialize(moved.observe(left_over, F.count(F.when(~F.col("done"), 1)).alias("models")), "step")
        finished.append(after.where("done"))
        active = after.where("not done")
        if not left_over.get["models"]:
            break
    state = reduce(DataFrame.unionByName, [*finished, active])

    predicted = _predicted(coded, state, f, c)
    whole = _by_model(_sums(predicted, entries, slopes=False), "sums").join(state, "model").join(totals, "model")
    if cluster:
        whole = whole.join(_meat(predicted, entries), "model")
    else:
        whole = whole.withColumns({"meat": F.lit(None).cast("array<struct<i:int,j:int,v:double>>"), "clusters": F.lit(None).cast("long")})
    found = materialize(whole.mapInArrow(_finished, _FOUND), "coefficients")

    name = F.element_at(F.array(*map(F.lit, names)), F.col("factor") + 1)
    wanted = F.element_at(F.array(*(F.lit(r).cast("string") for r in references)), F.col("factor") + 1)
    sound = wanted.isNull() | (wanted == F.col("base"))
    fitted = codes.where("at is not null").join(found, ["model", "at"]).select("model", name.alias("factor"), "level", *(F.when(sound, F.col(x)).alias(x) for x in ("beta", "se", "p")), "converged")
    nothing = F.lit(None).cast("double")
    others = gone.where(wanted.isNull() | (wanted != F.col("level"))).select("model", name.alias("factor"), "level", *(nothing.alias(x) for x in ("beta", "se", "p")), F.lit(None).cast("boolean").alias("converged"))
    told = fitted.unionByName(others)
    if c:
        number = F.element_at(F.array(*map(F.lit, numbers)), F.col("at"))
        told = told.unionByName(found.where(F.col("at").between(1, c)).select("model", number.alias("factor"), F.lit(None).cast("string").alias("level"), "beta", "se", "p", "converged"))
    return told.join(totals, "model").select("model", "factor", "level", "n", "beta", "se", "p", "converged")


def odds_ratios(df: DataFrame, flag: str, factors: dict[str, str | None], numbers: tuple[str, ...] = (), **options) -> DataFrame:
    """(model, factor, level, n, odds_ratio, lo, hi, p, converged): exp of coefficients() and of their 95 % intervals."""
    found = coefficients(df, flag, factors, numbers, **options)
    bound = lambda b: F.exp(F.least(F.lit(50.0), b))
    b, half = F.col("beta"), Z95 * F.col("se")
    return found.select("model", "factor", "level", "n", F.when(b.isNotNull(), bound(b)).alias("odds_ratio"), F.when(b.isNotNull(), bound(b - half)).alias("lo"), F.when(b.isNotNull(), bound(b + half)).alias("hi"), "p", "converged")
