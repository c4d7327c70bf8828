"""Variance partition of a random-intercept model from cell statistics.

The REML criterion of a model with hospital and unit intercepts follows from sums over the units of each hospital and
sums over hospitals of these. Both are aggregations, for many points and all metrics at once; the driver sees six
numbers for each point and metric, and chooses the next points.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.operators import variance as V
from recordloom.sources.scratch import materialize

#: Logarithms of variance ratios of the first grid, and distances between points around the best one, grid by grid.
COARSE, FINER = np.arange(-12.0, 13.0, 2.0), (0.7, 0.25, 0.09)
#: Distances of the points that slopes and curvatures are taken from, at last.
STENCILS = (0.03, 0.01, 0.005, 0.005)
#: Curvature that counts as none, and the rounding of a criterion as a part of its value.
FLAT, ROUNDING = 1e-4, 1e-13

VPC = "metric string, n long, hospitals long, units long, vpc_hospital double, vpc_unit double, converged boolean"


def hospital_sums(cells: DataFrame, points: DataFrame) -> DataFrame:
    """(metric, at, logs, unit, hospital, weight, first, second, within) of cells (metric, hospital, n, mean) at points (metric, at, lh, lu).

    unit and hospital are sums of log(1 + ratio * size); weight, first and second are moments of hospital means, within
    the squared deviations of unit means from them.
    """
    w = F.col("n") / (1 + F.col("lu") * F.col("n"))
    units = cells.join(points, "metric").groupBy("metric", "at", "lh", "hospital").agg(
        F.sum(w).alias("big"), F.sum(w * F.col("mean")).alias("s"), F.sum(w * F.col("mean") ** 2).alias("ss"), F.sum(F.log1p(F.col("lu") * F.col("n"))).alias("unit")
    )
    m, omega = F.col("s") / F.col("big"), F.col("big") / (1 + F.col("lh") * F.col("big"))
    return units.groupBy("metric", "at").agg(
        F.sum("unit").alias("unit"),
        F.sum(F.log1p(F.col("lh") * F.col("big"))).alias("hospital"),
        F.sum(omega).alias("weight"),
        F.sum(omega * m).alias("first"),
        F.sum(omega * m * m).alias("second"),
        F.sum(F.greatest(F.col("ss") - F.col("big") * m * m, F.lit(0.0))).alias("within"),
    )


def criteria(cells: DataFrame, facts: dict[str, tuple[float, float]], asked: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """-2 REML log likelihood without constants at each metric's points (log ratio of hospital, of unit).

    facts: (number of rows, squared deviations within units) of each metric; cells hold z-scores.
    """
    rows = [(m, i, *np.exp(np.clip(p, -25, 25)).tolist()) for m, ps in asked.items() for i, p in enumerate(ps)]
    points = F.broadcast(cells.sparkSession.createDataFrame(rows, "metric string, at int, lh double, lu double"))  # a grid for each metric
    out = {m: np.full(len(ps), np.inf) for m, ps in asked.items()}
    for r in hospital_sums(cells, points).collect():
        total, ssw = facts[r["metric"]]
        q = ssw + r["within"] + max(0.0, r["second"] - r["first"] ** 2 / r["weight"])
        out[r["metric"]][r["at"]] = (total - 1) * np.log(q) + r["unit"] + r["hospital"] + np.log(r["weight"])
    return out


def _square(centre: np.ndarray, step: float, reach: int) -> np.ndarray:
    offsets = np.arange(-reach, reach + 1) * step
    return centre + np.array([(a, b) for a in offsets for b in offsets])


def _newton(values: np.ndarray, step: float) -> np.ndarray | None:
    """The way from the centre of a 3 x 3 stencil to the minimum of its parabola; None if it has none nearby.

    A direction that is flat but for rounding, as that of a ratio of next to none, is not gone.
    """
    f = values.reshape(3, 3)
    slope = np.array([f[2, 1] - f[0, 1], f[1, 2] - f[1, 0]]) / (2 * step)
    bend = np.array([f[2, 1] - 2 * f[1, 1] + f[0, 1], f[1, 2] - 2 * f[1, 1] + f[1, 0]]) / step**2
    c = (f[2, 2] - f[2, 0] - f[0, 2] + f[0, 0]) / (4 * step**2)
    bent = bend > max(FLAT, ROUNDING * np.abs(f).max() / step**2)
    if bent.all() and bend.prod() > c * c:
        way = -np.linalg.solve(np.array([[bend[0], c], [c, bend[1]]]), slope)
    elif bent.any():
        way = np.where(bent, -slope / np.where(bent, bend, 1.0), 0.0)
    else:
        return None
    return way if np.abs(way).max() < 0.5 else None


def mixed_vpc(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Shares of variance of hospital and unit intercepts (REML), one row per metric.

    Values are z-scores. The criterion is looked up on grids around the best point so far, then at minima of parabolas;
    ratios of variances stay between exp(-12) and exp(12) or near. Under 100 rows or without variance the shares are null.
    There is no bound on units or hospitals. converged: the last steps were below 1e-3 and 1e-4, or ended at a ratio of next to none.
    """
    cells = materialize(V.metric_moments(df, metrics, ["hospital", "unit_id"]), "cells")
    grand = cells.groupBy("metric").agg(F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    centred = cells.join(F.broadcast(grand), "metric")
    off = F.col("n") * (F.col("mean") - F.col("grand")) ** 2
    facts = {r["metric"]: r for r in centred.groupBy("metric").agg(F.max("total").alias("n"), F.first("grand").alias("grand"), F.sum("m2").alias("m2"), F.sum(F.col("m2") + off).alias("sst"), F.count_distinct("hospital").alias("hospitals"), F.count("*").alias("units")).collect()}
    usable = {m: r for m, r in facts.items() if r["n"] >= 100 and r["sst"] > 0}
    sd = {m: float(np.sqrt(r["sst"] / (r["n"] - 1))) for m, r in usable.items()}
    found: dict[str, tuple[np.ndarray, bool]] = {}
    if usable:
        scale = F.broadcast(df.sparkSession.createDataFrame([(m, usable[m]["grand"], sd[m]) for m in usable], "metric string, grand double, sd double"))
        scores = materialize(cells.join(scale, "metric").select("metric", "hospital", F.col("n").cast("double").alias("n"), ((F.col("mean") - F.col("grand")) / F.col("sd")).alias("mean")), "scores")
        within = {m: (float(r["n"]), r["m2"] / sd[m] ** 2) for m, r in usable.items()}
        best = {m: np.zeros(2) for m in usable}
        for step in (None, *FINER):
            asked = {m: np.array([(a, b) for a in COARSE for b in COARSE]) if step is None else _square(best[m], step, 3) for m in usable}
            best = {m: asked[m][int(np.argmin(v))] for m, v in criteria(scores, within, asked).items()}
        steps: dict[str, list[float]] = {m: [] for m in usable}
        for step in STENCILS:
            asked = {m: _square(best[m], step, 1) for m in usable}
            for m, v in criteria(scores, within, asked).items():
                way = _newton(v, step)
                steps[m].append(float(np.abs(way).max()) if way is not None else 0.0 if best[m].min() < -9 else 1.0)
                best[m] = best[m] + way if way is not None else asked[m][int(np.argmin(v))]
        found = {m: (best[m], steps[m][-2] < 1e-3 and steps[m][-1] < 1e-4) for m in usable}
    rows = []
    for metric in metrics:
        r = facts.get(metric)
        if metric not in found:
            rows.append((metric, r["n"] if r else 0, r["hospitals"] if r else 0, r["units"] if r else 0, None, None, False))
            continue
        logs, converged = found[metric]
        h, u = np.exp(np.clip(logs, -25, 25))
        rows.append((metric, r["n"], r["hospitals"], r["units"], float(h / (1 + h + u)), float(u / (1 + h + u)), converged))
    return df.sparkSession.createDataFrame(rows, VPC)
