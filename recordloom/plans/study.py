"""The study's composite operators: profiles, variance decomposition, agreement, thresholds, associations, probes."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.config import DEFAULT, METRICS
from recordloom.functions import scalars as S
from recordloom.operators import agreement as A
from recordloom.operators import events as E
from recordloom.operators import logistic as L
from recordloom.operators import mixed as X
from recordloom.operators import replication
from recordloom.operators import resampling as B
from recordloom.operators import variance as V
from recordloom.plans.registry import BOTH, COHORT, MONITOR, NURSE, STAYS, cohort, eta2_sql, metrics, offset, query
from recordloom.sources import store
from recordloom.sources.tables import Star

M9 = list(METRICS)
M8 = M9[1:]
#: Group sizes on the stand-in tables, which are smaller than the study's.
MIN_HOSPITAL, MIN_CELL = 50, 10


def _rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def nurse_metrics(star: Star) -> DataFrame:
    return E.stay_metrics(E.in_window(star.nurse()))


def monitor_metrics(star: Star) -> DataFrame:
    return E.stay_metrics(E.in_window(star.monitor()))


def nurse_cohort(star: Star) -> DataFrame:
    return E.eligible(nurse_metrics(star), star.stays())


def monitor_cohort(star: Star) -> DataFrame:
    return E.eligible(monitor_metrics(star), star.stays())


def _union(selects: list[str]) -> str:
    return " UNION ALL ".join(selects)


# -- extraction


@query("""SELECT e.user_id AS stay_id, e.ts AS charttime, date_diff('microsecond', f.first, e.ts)::DOUBLE / 6e7 AS offset_min, f.los
FROM events e JOIN (SELECT user_id, min(ts) AS first, 2.5::DOUBLE AS los FROM events GROUP BY 1) f ON e.user_id = f.user_id
WHERE e.event_type = 'click' AND e.value BETWEEN 20 AND 250 AND date_diff('microsecond', f.first, e.ts)::DOUBLE / 6e7 < 1440""")
def extract_events_ts(star: Star) -> DataFrame:
    e = star.table("events")
    stays = e.groupBy(F.col("user_id").alias("stay_id")).agg(F.min("ts").alias("intime")).withColumn("los", F.lit(2.5))
    events = e.select(F.col("user_id").alias("stay_id"), F.col("event_type").alias("itemid"), F.col("ts").alias("charttime"), F.col("value").alias("valuenum"))
    return E.timestamped(events, stays, "click", 20, 250)


@query(f"WITH {MONITOR} SELECT stay_key, offset_min FROM monitor")
def extract_events_offset(star: Star) -> DataFrame:
    return E.in_window(star.monitor())


@query(f"""SELECT o_custkey AS stay_key, {offset('o_orderdate')} AS offset_min FROM orders
WHERE regexp_matches(o_orderpriority, '(?i)urgent|high') AND o_totalprice BETWEEN 1000 AND 200000 AND {offset('o_orderdate')} >= 0 AND {offset('o_orderdate')} < 1440""")
def extract_events_text(star: Star) -> DataFrame:
    o = star.table("orders").select(F.col("o_custkey").alias("stay_key"), F.datediff("o_orderdate", F.lit("1995-01-01")).alias("offset_min"), F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("name"), F.col("o_totalprice").cast("string").alias("value"))
    return E.textual(o, "urgent|high", 1000, 200000)


_RANGES = {"spo2": (50.0, 100.0), "resp": (4.0, 60.0)}


@query("""SELECT user_id AS stay_key, CASE event_type WHEN 'view' THEN 'spo2' ELSE 'resp' END AS variable, value FROM events
WHERE (event_type = 'view' AND value BETWEEN 50 AND 100) OR (event_type = 'click' AND value BETWEEN 4 AND 60)""")
def extract_multi_variable(star: Star) -> DataFrame:
    return E.multi_variable(star.clock(), {"view": "spo2", "click": "resp"}, _RANGES).select("stay_key", "variable", "value")


@query("""SELECT l_orderkey, l_linenumber, 'quantity' AS variable, l_quantity AS value FROM lineitem WHERE l_quantity BETWEEN 5 AND 30
UNION ALL SELECT l_orderkey, l_linenumber, 'discount', l_discount FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.08""")
def unpivot_events(star: Star) -> DataFrame:
    wide = star.table("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))
    return E.unpivoted(wide, {"quantity": (5, 30), "discount": (0.02, 0.08)}, ("l_orderkey", "l_linenumber"))


_STAY_METRICS = f"WITH {NURSE}, {metrics('nurse', 'nm')} SELECT stay_key, n_records::BIGINT AS n_records, round(t_first_h, 6) AS t_first_h, {', '.join(M9[2:])} FROM nm"


@query(_STAY_METRICS)
def stay_metrics(star: Star) -> DataFrame:
    return _rounded(nurse_metrics(star), "t_first_h")


@query(_STAY_METRICS)
def stay_metrics_store(star: Star) -> DataFrame:
    """Stay metrics from an event store: the lag and the aggregation read its buckets as they lie."""
    stored = store.events(star.spark, store.write_events(E.in_window(star.nurse()), DEFAULT.buckets))
    return _rounded(E.stay_metrics(stored), "t_first_h")


@query(f"WITH {NURSE}, {MONITOR} SELECT a.stay_key, a.n AS nurse_n, b.n AS monitor_n FROM (SELECT stay_key, count(*)::BIGINT AS n FROM nurse GROUP BY 1) a JOIN (SELECT stay_key, count(*)::BIGINT AS n FROM monitor GROUP BY 1) b ON a.stay_key = b.stay_key")
def join_streams_store(star: Star) -> DataFrame:
    """Both streams from stores of as many buckets: counted and joined by stay without an exchange."""
    stored = [store.events(star.spark, store.write_events(E.in_window(e), DEFAULT.buckets)) for e in (star.nurse(), star.monitor())]
    nurse, monitor = (e.groupBy("stay_key").agg(F.count("*").alias(n)) for e, n in zip(stored, ("nurse_n", "monitor_n")))
    return nurse.join(monitor.hint("merge"), "stay_key")


# -- variance


def _each(sql_of, names=M9, more: str = "") -> str:
    return COHORT + " " + _union([f"SELECT '{m}' AS metric, {sql_of(m)}{more} FROM (SELECT 1)" for m in names])


def _n(m: str, table: str = "c") -> str:
    return f"(SELECT count({m}) FROM {table})::BIGINT AS n"


@query(_each(lambda m: f"round({eta2_sql(m, 'hospital', 'c')}, 6) AS eta2, {_n(m)}"))
def eta2_hospital(star: Star) -> DataFrame:
    return _rounded(V.eta2(nurse_cohort(star), M9, "hospital"), "eta2")


@query(_each(lambda m: f"round({eta2_sql(m, 'unittype', 'c', 100)}, 6) AS eta2, {_n(m)}"))
def eta2_ols(star: Star) -> DataFrame:
    return _rounded(V.eta2(nurse_cohort(star), M9, "unittype", least=100), "eta2")


def _partial_sql(m: str, group: str, table: str = "c") -> str:
    return f"""(SELECT CASE WHEN n >= 100 AND syy > 0 AND rb <= 0.999 THEN ((1 - (wyy - CASE WHEN wxx > 0 THEN wxy * wxy / wxx ELSE 0 END) / syy) - rb) / (1 - rb) END FROM (
  SELECT *, sxy * sxy / (sxx * syy) AS rb FROM (
    SELECT count(*) AS n, sum((x - mx) ** 2) AS sxx, sum((y - my) ** 2) AS syy, sum((x - mx) * (y - my)) AS sxy,
           sum((x - gx) ** 2) AS wxx, sum((y - gy) ** 2) AS wyy, sum((x - gx) * (y - gy)) AS wxy
    FROM (SELECT x, y, avg(x) OVER () AS mx, avg(y) OVER () AS my, avg(x) OVER (PARTITION BY g) AS gx, avg(y) OVER (PARTITION BY g) AS gy
          FROM (SELECT ln(n_records) AS x, {m}::DOUBLE AS y, {group} AS g FROM {table} WHERE {m} IS NOT NULL)))))"""


@query(_each(lambda m: f"round({_partial_sql(m, 'hospital')}, 6) AS partial_eta2, {_n(m)}", M8))
def partial_eta2(star: Star) -> DataFrame:
    return _rounded(V.partial_eta2(nurse_cohort(star), M8, F.log("n_records"), "hospital"), "partial_eta2")


def _residual_sql(m: str) -> str:
    table = f"(SELECT hospital, y - b * (x - mx) AS res FROM (SELECT hospital, x, y, avg(x) OVER () AS mx, regr_slope(y, x) OVER () AS b FROM (SELECT hospital, ln(n_records) AS x, {m}::DOUBLE AS y FROM c WHERE {m} IS NOT NULL)))"
    return eta2_sql("res", "hospital", table)


@query(_each(lambda m: f"round({_residual_sql(m)}, 6) AS eta2_given_density, {_n(m)}", M8))
def eta2_given_density(star: Star) -> DataFrame:
    return _rounded(V.residual_eta2(nurse_cohort(star), M8, F.log("n_records"), "hospital"), "eta2_given_density")


def _nested(m: str) -> str:
    d, h, u = (eta2_sql(m, g, "c", 100) for g in ("database", "hospital", "unit_id"))
    return f"round({d}, 6) AS r2_database, round({h} - {d}, 6) AS r2_hospital, round({u} - {h}, 6) AS r2_unit, round({u}, 6) AS r2_total, {_n(m)}"


@query(_each(_nested))
def nested_r2(star: Star) -> DataFrame:
    return _rounded(V.nested_r2(nurse_cohort(star), M9), "r2_database", "r2_hospital", "r2_unit", "r2_total")


@query(_each(lambda m: f"round({eta2_sql(m, 'unit_id', 'c')} - {eta2_sql(m, 'hospital', 'c')}, 6) AS eta2_unit_within"))
def eta2_unit_within(star: Star) -> DataFrame:
    return _rounded(V.unit_within_hospital(nurse_cohort(star), M9), "eta2_unit_within").select("metric", "eta2_unit_within")


_BOOT = ["n_records", "median_interval_min"]
#: The metrics that the reference resamples.
_BOOT8 = [m for m in M9 if m != "n_gaps_gt4h"]


def _boot_sql(metrics_: list[str], replicates: int, density: bool) -> str:
    def given(m: str) -> str:
        """Of each replicate: eta2 over hospitals of what a straight line on log density leaves."""
        return f"""SELECT replicate, CASE WHEN any_value(n) >= 10 AND any_value(tyy - 2 * slope * txy + slope ** 2 * txx) > 1e-12 * any_value(tyy)
              THEN sum(wn * (hy - y / n - slope * (hx - x / n)) ** 2) / any_value(tyy - 2 * slope * txy + slope ** 2 * txx) END AS given FROM (
              SELECT *, CASE WHEN n >= 10 AND txx > 0 THEN txy / txx ELSE 0 END AS slope FROM (SELECT *, xx - x * x / n AS txx, xy - x * y / n AS txy, yy - y * y / n AS tyy FROM (
                SELECT replicate, n * weight AS wn, sx / n AS hx, sy / n AS hy, sum(n * weight) OVER w AS n, sum(sx * weight) OVER w AS x, sum(sy * weight) OVER w AS y,
                       sum(sxx * weight) OVER w AS xx, sum(sxy * weight) OVER w AS xy, sum(syy * weight) OVER w AS yy
                FROM (SELECT hospital, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy
                      FROM (SELECT hospital, ln(n_records) AS x, {m}::DOUBLE AS y FROM c WHERE {m} IS NOT NULL) GROUP BY hospital) JOIN weights USING (hospital)
                WINDOW w AS (PARTITION BY replicate)))) GROUP BY replicate"""

    def part(m: str) -> str:
        more = ", round(quantile_cont(given, 0.025), 6) AS given_density_lo, round(quantile_cont(given, 0.975), 6) AS given_density_hi" if density else ""
        joined = f"JOIN ({given(m)}) USING (replicate)" if density else ""
        return f"""SELECT '{m}' AS metric, count(*)::BIGINT AS replicates, round(quantile_cont(h, 0.025), 6) AS hospital_lo, round(quantile_cont(h, 0.975), 6) AS hospital_hi,
          round(quantile_cont(u - h, 0.025), 6) AS within_lo, round(quantile_cont(u - h, 0.975), 6) AS within_hi{more} FROM (
          SELECT replicate, sum(hn * (hmean - grand) ** 2) / any_value(sst) AS h, any_value(su) / any_value(sst) AS u FROM (
            SELECT replicate, hospital, any_value(hn) AS hn, any_value(hmean) AS hmean, any_value(grand) AS grand, any_value(sst) AS sst, any_value(su) AS su FROM (
              SELECT *, sum(m2 + n * (mean - grand) ** 2) OVER (PARTITION BY replicate) AS sst, sum(n * (mean - grand) ** 2) OVER (PARTITION BY replicate) AS su FROM (
                SELECT *, sum(n * mean) OVER (PARTITION BY replicate) / sum(n) OVER (PARTITION BY replicate) AS grand,
                       sum(n) OVER (PARTITION BY replicate, hospital) AS hn,
                       sum(n * mean) OVER (PARTITION BY replicate, hospital) / sum(n) OVER (PARTITION BY replicate, hospital) AS hmean
                FROM (SELECT replicate, hospital, n * weight AS n, mean, m2 * weight AS m2 FROM
                  (SELECT hospital, unit_id, count({m}) AS n, avg({m}::DOUBLE) AS mean, var_pop({m}::DOUBLE) * count({m}) AS m2 FROM c WHERE {m} IS NOT NULL GROUP BY 1, 2)
                  JOIN weights USING (hospital))))
            GROUP BY 1, 2)
          GROUP BY replicate) {joined}"""

    return f"""{COHORT}, names AS (SELECT hospital, row_number() OVER (ORDER BY hospital) - 1 AS i FROM (SELECT DISTINCT hospital FROM c)),
    weights AS (SELECT replicate, hospital, count(*) AS weight FROM (
      SELECT r AS replicate, (('0x' || substr(md5(r || ':' || d), 1, 8))::BIGINT % (SELECT count(*) FROM names)) AS i
      FROM range({replicates}) AS a(r), range((SELECT count(*) FROM names)) AS b(d)) JOIN names USING (i) GROUP BY 1, 2)
    """ + _union([part(m) for m in metrics_])


@query(_boot_sql(_BOOT, 200, False))
def bootstrap_hospital(star: Star) -> DataFrame:
    found = B.bootstrap_hospital(nurse_cohort(star), _BOOT, 200)
    return _rounded(found, "hospital_lo", "hospital_hi", "within_lo", "within_hi")


@query(_boot_sql(_BOOT8, DEFAULT.bootstraps, True))
def bootstrap_decomposition(star: Star) -> DataFrame:
    """The whole hospital bootstrap: three components of all resampled metrics."""
    found = B.bootstrap_hospital(nurse_cohort(star), _BOOT8, DEFAULT.bootstraps, F.log("n_records"))
    return _rounded(found, *(f"{part}_{end}" for part in ("hospital", "within", "given_density") for end in ("lo", "hi")))


def _drawn_sql(seed: int, *parts: str, out_of: str) -> str:
    """A number below out_of from hashes of all parts, in unsigned 64-bit arithmetic."""

    def mixed(x: str) -> str:
        shifted = lambda by, c: f"lambda v: (xor(v, v >> {by}) * {c}::UBIGINT) % 4294967296"
        return f"list_transform(list_transform(list_transform([{x}], {shifted(16, 2246822507)}), {shifted(13, 3266489909)}), lambda v: xor(v, v >> 16))[1]"

    h = mixed(f"{seed}::UBIGINT")
    for part in parts:
        h = mixed(f"xor({h}, ({part})::UBIGINT)")
    return f"(({h} * ({out_of})::UBIGINT) >> 32)::BIGINT"


def _stay_boot_sql(metrics_: list[str], replicates: int, seed: int) -> str:
    def part(m: str) -> str:
        return f"""SELECT '{m}' AS metric, count(*)::BIGINT AS replicates, round(quantile_cont(eta2, 0.025), 6) AS lo, round(quantile_cont(eta2, 0.975), 6) AS hi FROM (
          SELECT CASE WHEN sum(n) >= 10 AND sum(m2 + n * (mean - grand) ** 2) > 0 THEN sum(n * (mean - grand) ** 2) / sum(m2 + n * (mean - grand) ** 2) END AS eta2 FROM (
            SELECT *, sum(n * mean) OVER (PARTITION BY replicate) / sum(n) OVER (PARTITION BY replicate) AS grand FROM (
              SELECT replicate, unittype, count(*) AS n, avg({m}::DOUBLE) AS mean, var_pop({m}::DOUBLE) * count(*) AS m2 FROM chosen WHERE {m} IS NOT NULL GROUP BY 1, 2)) GROUP BY replicate)"""

    size = f"least({B.BLOCK}, (SELECT count(*) FROM c) - block * {B.BLOCK})"
    return f"""{COHORT}, placed AS (SELECT *, row_number() OVER (ORDER BY stay_key) - 1 AS place FROM c),
    falls AS (SELECT r AS replicate, {_drawn_sql(seed, "r", "d", out_of="(SELECT count(*) FROM c)")} // {B.BLOCK} AS block, count(*) AS drawn
      FROM range({replicates}) AS a(r), range((SELECT count(*) FROM c)) AS b(d) GROUP BY 1, 2),
    chosen AS (SELECT replicate, p.* FROM (
      SELECT replicate, block * {B.BLOCK} + {_drawn_sql(seed + 1, "block", "replicate", "t", out_of=size)} AS place FROM (SELECT *, unnest(range(drawn)) AS t FROM falls)) JOIN placed p USING (place))
    """ + _union([part(m) for m in metrics_])


@query(_stay_boot_sql(_BOOT8, DEFAULT.bootstraps, DEFAULT.seed))
def bootstrap_stay(star: Star) -> DataFrame:
    """Between-unit eta2 of all resampled metrics, with exactly as many draws as stays in each replicate."""
    return _rounded(B.bootstrap_stays(nurse_cohort(star), _BOOT8, "unittype", DEFAULT.bootstraps, DEFAULT.seed), "lo", "hi")


def _pctile_boot_sql(replicates: int, seed: int) -> str:
    return f"""{COHORT}, long AS ({_union([f"SELECT unit_id AS unit, '{m}' AS metric, {m}::DOUBLE AS value FROM c WHERE {m} IS NOT NULL" for m in _BOOT8])}),
    sizes AS (SELECT unit, metric, count(*) AS n, quantile_cont(value, 0.5) AS median FROM long GROUP BY 1, 2),
    middles AS (SELECT n, r, list_sort(list(place)) AS places FROM (
      SELECT n, r, {_drawn_sql(seed, "r", "t", out_of="n")} AS place FROM (SELECT n, r, unnest(range(n)) AS t FROM (SELECT DISTINCT n FROM sizes WHERE n > 10), range({replicates}) AS a(r))) GROUP BY 1, 2),
    sorted AS (SELECT unit, metric, list_sort(list(value)) AS v FROM long GROUP BY 1, 2),
    medians AS (SELECT s.unit, s.metric, r, (v[places[(n - 1) // 2 + 1] + 1] + v[places[n // 2 + 1] + 1]) / 2 AS value FROM sizes s JOIN middles USING (n) JOIN sorted o ON o.unit = s.unit AND o.metric = s.metric),
    ranks AS (SELECT m.unit, m.metric, r, any_value(value) AS value, avg((d.median < value)::INT) AS rank FROM medians m JOIN sizes d ON d.metric = m.metric GROUP BY 1, 2, 3),
    bounds AS (SELECT unit, metric, round(quantile_cont(rank, 0.025), 6) AS lo, round(quantile_cont(rank, 0.975), 6) AS hi FROM ranks GROUP BY 1, 2)
    SELECT s.unit, s.metric, s.n::BIGINT AS n, lo, hi FROM sizes s LEFT JOIN bounds b ON b.unit = s.unit AND b.metric = s.metric"""


@query(_pctile_boot_sql(DEFAULT.pctile_bootstraps, DEFAULT.seed))
def bootstrap_pctile(star: Star) -> DataFrame:
    """Intervals of the percentile rank of each unit's median, for all resampled metrics."""
    values = V.long_metrics(nurse_cohort(star), _BOOT8, ["unit_id"]).select(F.col("unit_id").alias("unit"), "metric", F.col("y").alias("value"))
    medians = values.groupBy("unit", "metric").agg(F.percentile("value", F.lit(0.5)).alias("value"))
    return _rounded(B.bootstrap_percentile(values, medians.select("metric", "value"), DEFAULT.pctile_bootstraps, DEFAULT.seed), "lo", "hi")


@query()
def mixed_vpc(star: Star) -> DataFrame:
    return X.mixed_vpc(nurse_cohort(star), ["n_records", "median_interval_min", "max_interval_min", "n_gaps_gt2h", "frac_time_in_gaps"])


# -- two streams


_TWO = f"{BOTH}, p AS (SELECT c.stay_key, c.n_records AS a, d.n_records AS b FROM c JOIN d ON c.stay_key = d.stay_key)"


def _pairs(star: Star) -> DataFrame:
    n = lambda df, name: df.select("stay_key", F.col("n_records").alias(name))
    return n(nurse_cohort(star), "a").join(n(monitor_cohort(star), "b"), "stay_key")


def _agreement_sql(columns: str) -> str:
    part = lambda p: f"""SELECT {p}::INT AS pct, n::BIGINT AS n, fa::BIGINT AS flagged_a, fb::BIGINT AS flagged_b, ab::BIGINT AS both_flagged, {columns.replace('PCT', str(p))} FROM (  
      SELECT count(*) AS n, sum((a <= qa)::INT) AS fa, sum((b <= qb)::INT) AS fb, sum((a <= qa AND b <= qb)::INT) AS ab, sum((a <= qa OR b <= qb)::INT) AS aob
      FROM p, (SELECT quantile_cont(a, {p / 100}) AS qa, quantile_cont(b, {p / 100}) AS qb FROM p))"""  # noqa: E731
    return _TWO + " " + _union([part(p) for p in DEFAULT.percentiles])


@query(_agreement_sql("round(ab / greatest(fa, 1)::DOUBLE, 6) AS observed, PCT / 100.0::DOUBLE AS chance_fixed, round(ab / greatest(aob, 1)::DOUBLE, 6) AS jaccard, round((fa - ab) / greatest(fa, 1)::DOUBLE, 6) AS reclassified"))
def flag_agreement(star: Star) -> DataFrame:
    f = A.flag_agreement(_pairs(star), "a", "b", DEFAULT.percentiles)
    return _rounded(f, "observed", "jaccard", "reclassified").select("pct", "n", "flagged_a", "flagged_b", F.col("both").alias("both_flagged"), "observed", "chance_fixed", "jaccard", "reclassified")


@query(_agreement_sql("round(ab / greatest(fa, 1)::DOUBLE, 6) AS observed, round(fb / n::DOUBLE, 6) AS chance, round((ab / greatest(fa, 1)::DOUBLE) / (fb / n::DOUBLE), 6) AS ratio"))
def chance_comparator(star: Star) -> DataFrame:
    f = A.flag_agreement(_pairs(star), "a", "b", DEFAULT.percentiles)
    return _rounded(f, "observed", "chance", "ratio").select("pct", "n", "flagged_a", "flagged_b", F.col("both").alias("both_flagged"), "observed", "chance", "ratio")


def _distribution(t: str, name: str) -> str:
    return f"SELECT '{name}' AS stream, count(*)::BIGINT AS n, round(avg(n_records), 6) AS mean, quantile_cont(n_records, 0.5)::DOUBLE AS median, quantile_cont(n_records, 0.1)::DOUBLE AS p10, quantile_cont(n_records, 0.9)::DOUBLE AS p90, quantile_cont(median_interval_min, 0.5)::DOUBLE AS median_interval FROM {t}"


@query(BOTH + " " + _union([_distribution("c", "nurse"), _distribution("d", "monitor")]))
def stream_distributions(star: Star) -> DataFrame:
    both = nurse_cohort(star).withColumn("stream", F.lit("nurse")).unionByName(monitor_cohort(star).withColumn("stream", F.lit("monitor")))
    q = lambda c, p: F.percentile(c, F.lit(p))
    return both.groupBy("stream").agg(F.count("*").alias("n"), F.round(F.avg("n_records"), 6).alias("mean"), q("n_records", 0.5).alias("median"), q("n_records", 0.1).alias("p10"), q("n_records", 0.9).alias("p90"), q("median_interval_min", 0.5).alias("median_interval"))


_POOL = f"{BOTH}, same AS (SELECT * FROM c), other AS (SELECT * FROM c WHERE database <> 'ASIA' UNION ALL SELECT * FROM d WHERE database = 'ASIA')"


def _pools(star: Star) -> dict[str, DataFrame]:
    c = nurse_cohort(star)
    return {"same": c, "other": c.where("database <> 'ASIA'").unionByName(monitor_cohort(star).where("database = 'ASIA'"))}


@query(_POOL + " " + _union([f"SELECT '{m}' AS metric, round({eta2_sql(m, 'database', 'same')}, 6) AS eta2_same, round({eta2_sql(m, 'database', 'other')}, 6) AS eta2_other FROM (SELECT 1)" for m in M9]))
def database_component(star: Star) -> DataFrame:
    """The database's share of variance if all databases give one stream, and if one of them gives the other."""
    parts = [V.eta2(df, M9, "database", f"eta2_{name}").drop("n") for name, df in _pools(star).items()]
    return _rounded(parts[0].join(parts[1], "metric"), "eta2_same", "eta2_other")


_CELLS = f"cells AS (SELECT *, CASE WHEN database = 'ASIA' THEN 'own' ELSE 'others' END AS side FROM c WHERE unit_id IN (SELECT unit_id FROM c GROUP BY 1 HAVING count(*) >= {MIN_CELL}))"


def _cells(star: Star) -> DataFrame:
    """Stays of unit cells of sufficient size, in long form."""
    big = E.large_groups(nurse_cohort(star), "unit_id", MIN_CELL)
    return V.long_metrics(big, _BOOT, ["database", "unit_id", "unittype"])


def _unit_medians(star: Star) -> DataFrame:
    return _cells(star).groupBy("database", "unit_id", "unittype", "metric").agg(F.count("*").alias("n"), F.percentile("y", F.lit(0.5)).alias("value"))


def _medians_sql() -> str:
    return f"{COHORT}, {_CELLS}, med AS (" + _union([f"SELECT database, unit_id, unittype, '{m}' AS metric, count({m})::BIGINT AS n, quantile_cont({m}, 0.5)::DOUBLE AS value FROM cells WHERE {m} IS NOT NULL GROUP BY 1, 2, 3" for m in _BOOT]) + ")"


@query(_medians_sql() + """ SELECT m.unit_id, m.metric, m.n, m.value, round((SELECT avg(CASE WHEN o.value < m.value THEN 1.0 ELSE 0.0 END) FROM med o WHERE o.metric = m.metric AND o.database <> 'ASIA'), 6)::DOUBLE AS percentile
FROM med m WHERE m.database = 'ASIA'""")
def unit_percentiles(star: Star) -> DataFrame:
    med = _unit_medians(star)
    own, others = med.where("database = 'ASIA'"), med.where("database <> 'ASIA'")
    return A.empirical_percentiles(own, others, ("metric",), "value").select("unit_id", "metric", "n", "value", F.round("percentile", 6).alias("percentile"))


@query(_medians_sql() + """ SELECT m.unit_id, m.unittype, m.metric, round(avg(CASE WHEN o.value < m.value THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS percentile, count(*)::BIGINT AS like_units
FROM med m JOIN med o ON o.metric = m.metric AND o.unittype = m.unittype AND o.database <> 'ASIA' WHERE m.database = 'ASIA' GROUP BY 1, 2, 3 HAVING count(*) >= 5""")
def matched_type(star: Star) -> DataFrame:
    med = _unit_medians(star)
    own, others = med.where("database = 'ASIA'"), med.where("database <> 'ASIA'")
    like = others.groupBy("metric", "unittype").agg(F.count("*").alias("like_units")).where("like_units >= 5")
    return A.empirical_percentiles(own.join(like, ["metric", "unittype"]), others, ("metric", "unittype"), "value").select("unit_id", "unittype", "metric", F.round("percentile", 6).alias("percentile"), "like_units")


@query(_medians_sql() + """ SELECT metric, count(*)::BIGINT AS units, min(pct) AS lowest, max(pct) AS highest FROM (
  SELECT m.metric, round((SELECT avg(CASE WHEN o.value < m.value THEN 1.0 ELSE 0.0 END) FROM med o WHERE o.metric = m.metric AND o.database <> 'ASIA'), 6)::DOUBLE AS pct FROM med m WHERE m.database = 'ASIA')
GROUP BY metric""")
def unit_position(star: Star) -> DataFrame:
    return unit_percentiles(star).groupBy("metric").agg(F.count("*").alias("units"), F.min("percentile").alias("lowest"), F.max("percentile").alias("highest"))


@query(f"""WITH {NURSE}, gaps AS (SELECT offset_min - lag(offset_min) OVER (PARTITION BY stay_key ORDER BY offset_min) AS gap FROM nurse)
SELECT count(*)::BIGINT AS n, quantile_cont(gap, 0.25)::DOUBLE AS q25, quantile_cont(gap, 0.5)::DOUBLE AS median, quantile_cont(gap, 0.75)::DOUBLE AS q75,
round(avg(CASE WHEN gap BETWEEN 55 AND 65 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS share_hourly FROM gaps WHERE gap > 30""")
def gap_cadence_check(star: Star) -> DataFrame:
    """Long gaps; quantiles come from counts of gap lengths."""
    w = Window.partitionBy("stay_key").orderBy("offset_min")
    gaps = E.in_window(star.nurse()).select((F.col("offset_min") - F.lag("offset_min").over(w)).alias("gap")).where("gap > 30")
    counted = gaps.groupBy("gap").agg(F.count("*").alias("f"))
    q = lambda p: F.percentile("gap", F.lit(p), F.col("f"))
    hourly = F.sum(F.when(F.col("gap").between(55, 65), F.col("f")).otherwise(0)) / F.sum("f")
    return counted.agg(F.sum("f").alias("n"), q(0.25).alias("q25"), q(0.5).alias("median"), q(0.75).alias("q75"), F.round(hourly, 6).alias("share_hourly"))


@query(f"""WITH {STAYS}, {NURSE}, {MONITOR}, {metrics('nurse', 'nm')},
a AS (SELECT unit_id, count(DISTINCT stay_key) AS na FROM monitor JOIN stays USING (stay_key) WHERE completed GROUP BY 1),
b AS (SELECT unit_id, count(*) AS nb FROM nm JOIN stays USING (stay_key) WHERE completed AND n_records >= 3 GROUP BY 1)
SELECT unit_id, na::BIGINT AS n_monitor, coalesce(nb, 0)::BIGINT AS n_nurse, round(coalesce(nb, 0) / na::DOUBLE, 6) AS share FROM a LEFT JOIN b USING (unit_id) WHERE na >= {MIN_CELL} AND coalesce(nb, 0) < {MIN_CELL}""")
def stream_coverage(star: Star) -> DataFrame:
    """Groups large in the monitor stream (stays with any record) and not in the nurse stream (three records)."""
    done = star.stays().where("completed").select("stay_key", "unit_id")
    a = E.in_window(star.monitor()).select("stay_key").dropDuplicates().join(done, "stay_key").groupBy("unit_id").agg(F.count("*").alias("n_monitor")).where(F.col("n_monitor") >= MIN_CELL)
    b = nurse_cohort(star).groupBy("unit_id").agg(F.count("*").alias("n_nurse"))
    big = b.where(F.col("n_nurse") >= MIN_CELL).select("unit_id")
    return a.join(big, "unit_id", "left_anti").join(b, "unit_id", "left").select("unit_id", "n_monitor", F.coalesce("n_nurse", F.lit(0)).alias("n_nurse"), F.round(F.coalesce("n_nurse", F.lit(0)) / F.col("n_monitor"), 6).alias("share"))


# -- thresholds


_BIG = f"{COHORT}, big AS (SELECT * FROM c WHERE hospital IN (SELECT hospital FROM c GROUP BY 1 HAVING count(*) >= {MIN_HOSPITAL // 2}))"


def _flags_sql() -> str:
    return f"{_BIG}, flags AS (" + _union([f"SELECT {p}::INT AS pct, hospital, n_records <= (SELECT quantile_cont(n_records, {p / 100}) FROM big) AS lg, n_records <= cut AS ll FROM big JOIN (SELECT hospital, quantile_cont(n_records, {p / 100}) AS cut FROM big GROUP BY 1) USING (hospital)" for p in DEFAULT.percentiles]) + "), shares AS (SELECT pct, hospital, count(*)::BIGINT AS n, sum(lg::INT)::BIGINT AS flagged, sum(lg::INT) / count(*)::DOUBLE AS share FROM flags GROUP BY 1, 2)"


def _flags(star: Star) -> DataFrame:
    big = E.large_groups(nurse_cohort(star), "hospital", MIN_HOSPITAL // 2)
    return A.threshold_flags(big.select("stay_key", "hospital", "n_records"), "n_records", "hospital", DEFAULT.percentiles)


@query(_flags_sql() + """ SELECT f.*, s.* EXCLUDE (pct) FROM (
  SELECT pct, count(*)::BIGINT AS n, sum(lg::INT)::BIGINT AS flagged_global, sum(ll::INT)::BIGINT AS flagged_local, sum((lg AND ll)::INT)::BIGINT AS both_flagged,
    round(sum((lg AND ll)::INT) / greatest(sum((lg OR ll)::INT), 1)::DOUBLE, 6) AS jaccard, round(sum((lg <> ll)::INT) / count(*)::DOUBLE, 6) AS share_changed,
    round((sum(lg::INT) - sum((lg AND ll)::INT)) / greatest(sum(lg::INT), 1)::DOUBLE, 6) AS reclassified FROM flags GROUP BY 1) f
JOIN (SELECT pct, count(*)::BIGINT AS groups, round(min(share), 6) AS share_min, round(quantile_cont(share, 0.25), 6) AS share_q25, round(quantile_cont(share, 0.5), 6) AS share_median,
    round(quantile_cont(share, 0.75), 6) AS share_q75, round(max(share), 6) AS share_max, sum((share < 0.01)::INT)::BIGINT AS groups_under_1pct, sum((share > 0.5)::INT)::BIGINT AS groups_over_50pct
  FROM shares GROUP BY 1) s ON f.pct = s.pct""")
def threshold_agreement(star: Star) -> DataFrame:
    t = A.threshold_agreement(_flags(star), "hospital").withColumnRenamed("both", "both_flagged")
    return _rounded(t, "jaccard", "share_changed", "reclassified", "share_min", "share_q25", "share_median", "share_q75", "share_max")


@query(_flags_sql() + " SELECT pct, hospital, n, flagged, round(share, 6) AS share FROM shares")
def group_shares(star: Star) -> DataFrame:
    return _rounded(A.group_shares(_flags(star), "hospital"), "share")


_TOP = _flags_sql() + ", ranked AS (SELECT hospital, n, flagged, sum(flagged) OVER (ORDER BY flagged DESC, hospital ROWS UNBOUNDED PRECEDING) / (sum(flagged) OVER ())::DOUBLE AS cumulative, row_number() OVER (ORDER BY flagged DESC, hospital)::INT AS rank FROM shares WHERE pct = 10 AND flagged > 0)"


@query(_TOP + " SELECT hospital, n, flagged, round(cumulative, 6) AS cumulative, rank FROM ranked WHERE rank <= 10")
def top_contributors(star: Star) -> DataFrame:
    return _rounded(A.contributions(A.group_shares(_flags(star), "hospital"), "hospital", 10).where("rank <= 10"), "cumulative")


@query(_TOP + " SELECT (count(*) FILTER (WHERE cumulative < 0.5) + 1)::BIGINT AS n_half FROM ranked")
def half_mass_groups(star: Star) -> DataFrame:
    """How many groups make up half of the flagged stays."""
    c = A.contributions(A.group_shares(_flags(star), "hospital"), "hospital", 10)
    return c.agg((F.sum((F.col("cumulative") < 0.5).cast("long")) + 1).alias("n_half"))


# -- eligibility


_ALL = f"WITH {STAYS}, {NURSE}, {metrics('nurse', 'nm')}, e AS (SELECT s.*, coalesce(n_records, 0) AS n FROM stays s LEFT JOIN nm USING (stay_key) WHERE completed)"


def _all_stays(star: Star) -> DataFrame:
    """Stays that completed the window, those without records included as 0."""
    return star.stays().where("completed").join(nurse_metrics(star).select("stay_key", "n_records"), "stay_key", "left").withColumn("n", F.coalesce("n_records", F.lit(0)))


@query(_ALL + " SELECT count(*)::BIGINT AS stays, " + ", ".join(f"round(avg(CASE WHEN n = {k} THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS share_{k}" for k in (0, 1, 2)) + ", round(avg(CASE WHEN n >= 3 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS share_eligible FROM e")
def eligibility_shares(star: Star) -> DataFrame:
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    n = F.col("n")
    return _all_stays(star).agg(F.count("*").alias("stays"), *[share(n == k).alias(f"share_{k}") for k in (0, 1, 2)], share(n >= 3).alias("share_eligible"))


@query(_ALL + f" SELECT hospital, count(*)::BIGINT AS stays, round(avg(CASE WHEN n < 3 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS share_excluded, quantile_cont(CASE WHEN n >= 3 THEN n END, 0.5)::DOUBLE AS median_n FROM e GROUP BY 1 HAVING count(*) >= {MIN_HOSPITAL}")
def eligibility_by_group(star: Star) -> DataFrame:
    g = _all_stays(star).groupBy("hospital").agg(F.count("*").alias("stays"), F.round(F.avg((F.col("n") < 3).cast("double")), 6).alias("share_excluded"), F.percentile(F.when(F.col("n") >= 3, F.col("n")), F.lit(0.5)).alias("median_n"))
    return g.where(F.col("stays") >= MIN_HOSPITAL)


@query(_ALL + f", f AS (SELECT * FROM e WHERE n >= 3) SELECT 'all' AS rule, (SELECT count(*) FROM e)::BIGINT AS stays, round({eta2_sql('n', 'hospital', 'e')}, 6) AS eta2 UNION ALL SELECT 'three', (SELECT count(*) FROM f)::BIGINT, round({eta2_sql('n', 'hospital', 'f')}, 6)")
def eligibility_eta2(star: Star) -> DataFrame:
    e = _all_stays(star)
    part = lambda df, rule: V.eta2(df, ["n"], "hospital").select(F.lit(rule).alias("rule"), F.col("n").alias("stays"), F.round("eta2", 6).alias("eta2"))
    return part(e, "all").unionByName(part(e.where("n >= 3"), "three"))


# -- profiles


@query(f"{COHORT} SELECT unit_id, count(*)::BIGINT AS n, " + ", ".join(f"quantile_cont({m}, 0.5)::DOUBLE AS {m}" for m in M9) + f" FROM c GROUP BY 1 HAVING count(*) >= {MIN_CELL}")
def group_profile(star: Star) -> DataFrame:
    c = nurse_cohort(star)
    return c.groupBy("unit_id").agg(F.count("*").alias("n"), *[F.percentile(m, F.lit(0.5)).alias(m) for m in M9]).where(F.col("n") >= MIN_CELL)


@query(f"{COHORT} SELECT unittype, count(*)::BIGINT AS n, " + ", ".join(f"quantile_cont({m}, 0.5)::DOUBLE AS {m}" for m in M9) + " FROM c GROUP BY 1")
def unit_profile(star: Star) -> DataFrame:
    return nurse_cohort(star).groupBy("unittype").agg(F.count("*").alias("n"), *[F.percentile(m, F.lit(0.5)).alias(m) for m in M9])


@query(f"{COHORT}, med AS (" + _union([f"SELECT '{m}' AS metric, unittype, quantile_cont({m}, 0.5)::DOUBLE AS v FROM c GROUP BY unittype" for m in M9]) + ") SELECT metric, min(v) AS lo, max(v) AS hi, round(CASE WHEN min(v) > 0 THEN max(v) / min(v) END, 6) AS ratio FROM med GROUP BY 1")
def unit_spread(star: Star) -> DataFrame:
    long = V.long_metrics(nurse_cohort(star), M9, ["unittype"]).groupBy("metric", "unittype").agg(F.percentile("y", F.lit(0.5)).alias("v"))
    return long.groupBy("metric").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("ratio", F.round(F.when(F.col("lo") > 0, F.col("hi") / F.col("lo")), 6))


@query(f"{COHORT} SELECT unittype, count(*)::BIGINT AS n, quantile_cont(n_records, 0.5)::DOUBLE AS median_n, quantile_cont(max_interval_min, 0.5)::DOUBLE AS median_max_gap FROM c WHERE n_records <= (SELECT quantile_cont(n_records, 0.1) FROM c) GROUP BY 1")
def low_tail_profile(star: Star) -> DataFrame:
    c = nurse_cohort(star)
    low = c.crossJoin(F.broadcast(A.quantile(c, "n_records", [0.1]).select("cut"))).where("n_records <= cut")
    return low.groupBy("unittype").agg(F.count("*").alias("n"), F.percentile("n_records", F.lit(0.5)).alias("median_n"), F.percentile("max_interval_min", F.lit(0.5)).alias("median_max_gap"))


_RHYTHM = "SELECT c_mktsegment AS unittype, hour(ts)::INT AS h, count(*)::BIGINT AS n FROM events JOIN customer ON user_id = c_custkey GROUP BY 1, 2"


def _rhythm(events: DataFrame, by: str) -> DataFrame:
    """Records, share and rank of each hour within a group; ties of the rank by hour."""
    n = events.groupBy(by, F.hour("ts").alias("h")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by)
    return n.withColumns({"share": F.col("n") / F.sum("n").over(w), "place": F.row_number().over(w.orderBy(F.desc("n"), "h"))})


def _peaks(rhythm: DataFrame, by: str) -> DataFrame:
    top = rhythm.where("place <= 3")
    return top.groupBy(by).agg(F.round(F.sum("share"), 6).alias("top3_share"), F.array_sort(F.collect_list("h")).alias("top_hours"))


def _peaks_sql(inner: str, by: str) -> str:
    return f"SELECT {by}, round(sum(share), 6) AS top3_share, list_sort(list(h)) AS top_hours FROM (SELECT *, n / (sum(n) OVER (PARTITION BY {by}))::DOUBLE AS share, row_number() OVER (PARTITION BY {by} ORDER BY n DESC, h) AS place FROM ({inner})) WHERE place <= 3 GROUP BY 1"


@query(_peaks_sql(_RHYTHM, "unittype"))
def unit_rhythm(star: Star) -> DataFrame:
    e = star.clock().join(star.stays().select("stay_key", "unittype"), "stay_key")
    return _peaks(_rhythm(e, "unittype"), "unittype")


_ITEMS = "SELECT event_type AS item, hour(ts)::INT AS h, count(*)::BIGINT AS n FROM events GROUP BY 1, 2"


@query(f"SELECT item, h, n, round(n / (sum(n) OVER (PARTITION BY item))::DOUBLE, 6) AS share FROM ({_ITEMS})")
def hour_share(star: Star) -> DataFrame:
    return _rounded(_rhythm(star.clock(), "item").drop("place"), "share")


@query(_peaks_sql(_ITEMS, "item"))
def hour_concentration(star: Star) -> DataFrame:
    return _peaks(_rhythm(star.clock(), "item"), "item")


@query("SELECT event_type AS item, count(*)::BIGINT AS records, count(DISTINCT user_id)::BIGINT AS stays, count(CASE WHEN value >= 2 THEN value END)::BIGINT AS nonnull, round_even(count(*) / count(DISTINCT user_id)::DOUBLE, 2) AS per_stay FROM events GROUP BY 1")
def item_volume(star: Star) -> DataFrame:
    e = star.clock()
    return e.groupBy("item").agg(F.count("*").alias("records"), F.countDistinct("stay_key").alias("stays"), F.count(F.when(F.col("value") >= 2, F.col("value"))).alias("nonnull"), F.bround(F.count("*") / F.countDistinct("stay_key"), 2).alias("per_stay"))


def _transport(m: str) -> str:
    big = f"(SELECT * FROM c WHERE hospital IN (SELECT hospital FROM c GROUP BY 1 HAVING count(*) >= {MIN_HOSPITAL // 2}))"
    q = lambda p: f"(SELECT quantile_cont(v, {p}) FROM (SELECT quantile_cont({m}, 0.5)::DOUBLE AS v FROM {big} GROUP BY hospital))"
    return f"round({eta2_sql(m, 'unittype', 'c', 100)}, 6) AS eta2_unittype, round({eta2_sql(m, 'hospital', big, 100)}, 6) AS eta2_hospital, round({_partial_sql(m, 'hospital', big)}, 6) AS partial_hospital, round({q(0.1)}, 6) AS p10, round({q(0.9)}, 6) AS p90"


@query(_each(_transport, M8))
def transport_report(star: Star) -> DataFrame:
    """How far each metric travels: shares of variance by unit type and hospital, and the spread of hospital medians."""
    c = nurse_cohort(star)
    big = E.large_groups(c, "hospital", MIN_HOSPITAL // 2)
    medians = V.long_metrics(big, M8, ["hospital"]).groupBy("metric", "hospital").agg(F.percentile("y", F.lit(0.5)).alias("v"))
    spread = medians.groupBy("metric").agg(F.percentile("v", F.lit(0.1)).alias("p10"), F.percentile("v", F.lit(0.9)).alias("p90"))
    found = V.eta2(c, M8, "unittype", "eta2_unittype", 100).drop("n").join(V.eta2(big, M8, "hospital", "eta2_hospital", 100).drop("n"), "metric")
    found = found.join(V.partial_eta2(big, M8, F.log("n_records"), "hospital").select("metric", F.col("partial_eta2").alias("partial_hospital")), "metric").join(spread, "metric")
    return _rounded(found, "eta2_unittype", "eta2_hospital", "partial_hospital", "p10", "p90")


_HARMONISED = f"{BOTH}, cb AS (SELECT * FROM c WHERE hospital IN (SELECT hospital FROM c GROUP BY 1 HAVING count(*) >= {MIN_HOSPITAL // 2})), db AS (SELECT * FROM d WHERE hospital IN (SELECT hospital FROM d GROUP BY 1 HAVING count(*) >= {MIN_HOSPITAL // 2}))"


@query(_HARMONISED + " " + _union([f"SELECT '{stream}' AS stream, '{rule}' AS cohort, (SELECT count(*) FROM {t})::BIGINT AS stays, round({eta2_sql('n_records', 'hospital', t)}, 6) AS eta2_hospital, round({eta2_sql('n_records', 'unit_id', t)} - {eta2_sql('n_records', 'hospital', t)}, 6) AS eta2_unit_within FROM (SELECT 1)" for stream, rule, t in (("nurse", "all", "c"), ("nurse", "large", "cb"), ("monitor", "all", "d"), ("monitor", "large", "db"))]))
def harmonised_components(star: Star) -> DataFrame:
    out = None
    for stream, df in (("nurse", nurse_cohort(star)), ("monitor", monitor_cohort(star))):
        for rule, part in (("all", df), ("large", E.large_groups(df, "hospital", MIN_HOSPITAL // 2))):
            row = V.unit_within_hospital(part, ["n_records"]).select(F.lit(stream).alias("stream"), F.lit(rule).alias("cohort"), F.col("n").alias("stays"), F.round("eta2_hospital", 6).alias("eta2_hospital"), F.round("eta2_unit_within", 6).alias("eta2_unit_within"))
            out = row if out is None else out.unionByName(row)
    return out


_SPEARMAN = "(SELECT round(corr(ra, rb), 6) FROM (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM p))"


@query(f"""{BOTH}, p AS (SELECT c.stay_key, c.n_records AS a, d.n_records AS b FROM c JOIN d ON c.stay_key = d.stay_key),
same AS (SELECT * FROM c), other AS (SELECT * FROM c WHERE database <> 'ASIA' UNION ALL SELECT * FROM d WHERE database = 'ASIA')
SELECT (SELECT count(*) FROM p)::BIGINT AS pairs, {_SPEARMAN} AS spearman,
(SELECT round(sum((a <= qa AND b <= qb)::INT) / greatest(sum((a <= qa)::INT), 1)::DOUBLE, 6) FROM p, (SELECT quantile_cont(a, 0.1) AS qa, quantile_cont(b, 0.1) AS qb FROM p)) AS agreement_10,
round({eta2_sql('n_records', 'database', 'same')}, 6) AS database_same, round({eta2_sql('n_records', 'database', 'other')}, 6) AS database_other,
round({eta2_sql('n_records', 'hospital', 'c')}, 6) AS eta2_hospital, round({eta2_sql('n_records', 'unit_id', 'c')} - {eta2_sql('n_records', 'hospital', 'c')}, 6) AS eta2_unit_within""")
def cross_variable_summary(star: Star) -> DataFrame:
    """One wide row: agreement, database component and hospital components of a variable."""
    pairs = _pairs(star)
    parts = [
        pairs.agg(F.count("*").alias("pairs")),
        A.spearman(pairs, "a", "b").select(F.round("spearman", 6).alias("spearman")),
        A.flag_agreement(pairs, "a", "b", (10,)).select(F.round("observed", 6).alias("agreement_10")),
        *[V.eta2(df, ["n_records"], "database").select(F.round("eta2", 6).alias(f"database_{name}")) for name, df in _pools(star).items()],
        V.unit_within_hospital(nurse_cohort(star), ["n_records"]).select(F.round("eta2_hospital", 6).alias("eta2_hospital"), F.round("eta2_unit_within", 6).alias("eta2_unit_within")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # every part is one row
    return out


_VARIABLES = {"hr": 0, "map": 1, "resp": 2}
_CROSS_CELL = 4


def _cross_sql() -> str:
    def part(v: str, i: int) -> str:
        stream = lambda name: f"{name} AS (SELECT x.* EXCLUDE (variable) FROM {name}_all x WHERE variable = '{v}')"
        own, nurse, monitor = "c WHERE database = 'ASIA'", "c WHERE database <> 'ASIA'", "d WHERE database <> 'ASIA'"
        pools = [f"{m}_{s}" for m in ("n_records", "median_interval_min") for s in ("nurse", "monitor")]
        pool_of = {s: f"(SELECT *, database = 'ASIA' AS side FROM (SELECT * FROM {own} UNION ALL SELECT * FROM {nurse if s == 'nurse' else monitor})) q" for s in ("nurse", "monitor")}
        database = ", ".join(f"round({eta2_sql(p.rsplit('_', 1)[0], 'side', pool_of[p.rsplit('_', 1)[1]])}, 6) AS database_{p}" for p in pools)
        hospital = ", ".join(f"round({eta2_sql(m, 'hospital', 'e')}, 6) AS hospital_{m}, round({eta2_sql(m, 'unit_id', 'e')} - {eta2_sql(m, 'hospital', 'e')}, 6) AS unit_{m}" for m in ("n_records", "median_interval_min", "frac_time_in_gaps"))
        medians = lambda t: f"(SELECT quantile_cont(n_records, 0.5) AS v FROM {t} GROUP BY unit_id HAVING count(*) >= {_CROSS_CELL})"
        position = ", ".join(f"(SELECT round({f}(p), 6) FROM (SELECT (SELECT avg((o.v < m.v)::INT) FROM {medians(t)} o) AS p FROM {medians(own)} m)) AS position_{f}_{s}" for s, t in (("nurse", nurse), ("monitor", monitor)) for f in ("min", "max"))
        return f"""(WITH {stream('nurse')}, {stream('monitor')}, {metrics('nurse', 'nm')}, {cohort('nm', 'c')}, {metrics('monitor', 'mm')}, {cohort('mm', 'd')},
        p AS (SELECT d.n_records AS a, c.n_records AS b FROM c JOIN d ON c.stay_key = d.stay_key WHERE c.database <> 'ASIA'),
        f AS (SELECT a <= (SELECT quantile_cont(a, 0.1) FROM p) AS fa, b <= (SELECT quantile_cont(b, 0.1) FROM p) AS fb FROM p),
        e AS (SELECT * FROM {nurse} AND hospital IN (SELECT hospital FROM {nurse} GROUP BY 1 HAVING count(*) >= {MIN_CELL}))
        SELECT '{v}' AS variable, (SELECT count(*) FROM p)::BIGINT AS n_both, {_SPEARMAN} AS spearman,
          (SELECT round(sum((fa AND fb)::INT) / greatest(sum(fa::INT), 1)::DOUBLE, 6) FROM f) AS agreement, (SELECT round(sum((fa AND fb)::INT) / greatest(sum((fa OR fb)::INT), 1)::DOUBLE, 6) FROM f) AS jaccard,
          {database}, {hospital}, {position})"""

    named = lambda key: "CASE " + key + " % 3 " + " ".join(f"WHEN {i} THEN '{v}'" for v, i in _VARIABLES.items()) + " END AS variable"
    return f"""WITH {STAYS},
    nurse_all AS (SELECT * FROM (SELECT o_custkey AS stay_key, {named('o_orderkey')}, {offset('o_orderdate')} AS offset_min FROM orders) WHERE offset_min >= 0 AND offset_min < 1440),
    monitor_all AS (SELECT * FROM (SELECT o_custkey AS stay_key, {named('l_partkey')}, {offset('l_shipdate')} AS offset_min FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE offset_min >= 0 AND offset_min < 1440)
    """ + _union([f"SELECT * FROM {part(v, i)}" for v, i in _VARIABLES.items()])


@query(_cross_sql())
def cross_variable_table(star: Star) -> DataFrame:
    """The whole replication: agreement, database, hospital and unit components and positions, a row for each of three variables."""
    found = replication.cross_variable_table(star.nurse_variables(_VARIABLES), star.monitor_variables(_VARIABLES), star.stays(), "ASIA", least_hospital=MIN_CELL, least_cell=_CROSS_CELL)
    return _rounded(found, *(c for c in found.columns if c not in ("variable", "n_both")))


# -- reconstruction and reconciliation


_TYPES = ("click", "error", "purchase", "signup", "view")
_TARGET = "sum((event_type IN ('click', 'view') OR (event_type = 'error' AND value > 300))::INT)"
_SETS = [c for k in range(1, 5) for c in combinations(_TYPES, k)]


def _set_sql(c: tuple[str, ...]) -> str:
    total = " + ".join(c)
    return f"SELECT '{'+'.join(c)}' AS items, round(avg(({total} = target)::INT), 6)::DOUBLE AS exact, round(avg({total} - target), 6)::DOUBLE AS mean_diff, round(avg(abs({total} - target)), 6)::DOUBLE AS mean_abs_diff FROM counts"


@query("WITH counts AS (SELECT user_id, " + ", ".join(f"sum((event_type = '{t}')::INT) AS {t}" for t in _TYPES) + f", {_TARGET} AS target FROM events GROUP BY 1) " + _union([_set_sql(c) for c in _SETS]))
def subset_reconstruction(star: Star) -> DataFrame:
    """How well the count of each set of up to four items reproduces a given count; one aggregation for all sets."""
    e = star.table("events")
    target = F.col("event_type").isin("click", "view") | ((F.col("event_type") == "error") & (F.col("value") > 300))
    counts = e.groupBy("user_id").agg(*[F.sum((F.col("event_type") == t).cast("int")).alias(t) for t in _TYPES], F.sum(target.cast("int")).alias("target"))
    aggs: list[Column] = []
    for c in _SETS:
        diff = S.complete_sum(*[F.col(t) for t in c]) - F.col("target")
        parts = (F.lit("+".join(c)).alias("items"), F.avg((diff == 0).cast("double")).alias("exact"), F.avg(diff).alias("mean_diff"), F.avg(F.abs(diff)).alias("mean_abs_diff"))
        aggs.append(F.struct(*parts))
    rows = counts.agg(F.array(*aggs).alias("sets")).select(F.inline("sets"))
    return _rounded(rows, "exact", "mean_diff", "mean_abs_diff")


_COUNTS = f"{BOTH}, t AS (SELECT c.stay_key, c.n_records::BIGINT AS x, d.n_records::BIGINT AS y, (c.n_gaps_gt30m + 1)::BIGINT AS z FROM c JOIN d ON c.stay_key = d.stay_key)"


def _reconcile_sql(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS first, '{b}' AS second, count(*)::BIGINT AS n, round(avg(({a} = {b})::INT), 6)::DOUBLE AS exact, round(corr({a}, {b}), 6) AS pearson,
    round(avg({a} - {b}), 6)::DOUBLE AS mean_diff, round(avg(abs({a} - {b})), 6)::DOUBLE AS mean_abs_diff, quantile_cont({a}, 0.5)::DOUBLE AS median_first, quantile_cont({b}, 0.5)::DOUBLE AS median_second,
    round(quantile_cont({b} / nullif({a}, 0)::DOUBLE, 0.5), 6) AS median_ratio, quantile_cont({a}, 0.1)::DOUBLE AS p10_first, quantile_cont({b}, 0.1)::DOUBLE AS p10_second,
    sum(({a} <= qa AND {b} <= qb)::INT)::BIGINT AS low_both, round(sum(({a} <= qa AND {b} <= qb)::INT) / greatest(sum(({a} <= qa)::INT), 1)::DOUBLE, 6) AS low_overlap
    FROM t, (SELECT quantile_cont({a}, 0.1) AS qa, quantile_cont({b}, 0.1) AS qb FROM t)"""


@query(_COUNTS + " " + _union([_reconcile_sql(*p) for p in combinations("xyz", 2)]))
def count_reconciliation(star: Star) -> DataFrame:
    """Three definitions of a count, compared pair by pair."""
    c = nurse_cohort(star).select("stay_key", F.col("n_records").alias("x"), (F.col("n_gaps_gt30m") + 1).alias("z"))
    t = c.join(monitor_cohort(star).select("stay_key", F.col("n_records").alias("y")), "stay_key")
    cuts = t.agg(*[F.percentile(k, F.lit(0.1)).alias(f"q{k}") for k in "xyz"])
    t = t.crossJoin(F.broadcast(cuts))  # one row
    out = None
    for a, b in combinations("xyz", 2):
        low_a, low_b = F.col(a) <= F.col(f"q{a}"), F.col(b) <= F.col(f"q{b}")
        both = F.sum((low_a & low_b).cast("long"))
        diff = F.col(a) - F.col(b)
        q = lambda c, p: F.percentile(c, F.lit(p))
        row = t.agg(
            F.lit(a).alias("first"), F.lit(b).alias("second"), F.count("*").alias("n"), F.round(F.avg((diff == 0).cast("double")), 6).alias("exact"), F.round(F.corr(a, b), 6).alias("pearson"),
            F.round(F.avg(diff), 6).alias("mean_diff"), F.round(F.avg(F.abs(diff)), 6).alias("mean_abs_diff"), q(a, 0.5).alias("median_first"), q(b, 0.5).alias("median_second"),
            F.round(q(S.safe_ratio(F.col(b), F.col(a)), 0.5), 6).alias("median_ratio"), q(a, 0.1).alias("p10_first"), q(b, 0.1).alias("p10_second"),
            both.alias("low_both"), F.round(both / F.greatest(F.sum(low_a.cast("long")), F.lit(1)), 6).alias("low_overlap"),
        )
        out = row if out is None else out.unionByName(row)
    return out


# -- probes


@query(_union([f"SELECT '{v}' AS variable, p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i){p}')" for v, p in (("ring", r"\bring\b"), ("colour", "^(red|blue)"))]))
def candidate_items(star: Star) -> DataFrame:
    out = None
    for v, p in (("ring", r"\bring\b"), ("colour", "^(red|blue)")):
        part = star.table("part").where(S.contains_any_case(F.col("p_name"), p)).select(F.lit(v).alias("variable"), "p_partkey", "p_name")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT p_name, count(*)::BIGINT AS n, coalesce(regexp_matches(p_name, '(?i)ring|bolt'), false) AS hit FROM part WHERE p_name IS NOT NULL GROUP BY 1")
def string_inventory(star: Star) -> DataFrame:
    n = star.table("part").na.drop(subset=["p_name"]).groupBy("p_name").agg(F.count("*").alias("n"))
    return n.withColumn("hit", S.contains_any_case(F.col("p_name"), "ring|bolt"))


@query(f"""WITH {STAYS}, {NURSE}, per AS (SELECT stay_key, count(*) AS k FROM nurse GROUP BY 1)
SELECT round(count(k) / count(*)::DOUBLE, 6) AS share, quantile_cont(k, 0.5)::DOUBLE AS median_values, sum(k)::BIGINT AS n_values FROM stays LEFT JOIN per USING (stay_key)""")
def coverage_probe(star: Star) -> DataFrame:
    """Share of stays with a value in the window, values per covered stay, values in all."""
    per = E.in_window(star.nurse()).groupBy("stay_key").agg(F.count("*").alias("k"))
    return star.stays().select("stay_key").join(per, "stay_key", "left").agg(F.round(F.count("k") / F.count("*"), 6).alias("share"), F.percentile("k", F.lit(0.5)).alias("median_values"), F.sum("k").alias("n_values"))


@query("SELECT id::INT AS id FROM (VALUES (1), (5), (-7), (999999999)) AS t(id) WHERE id NOT IN (SELECT p_partkey FROM part)")
def missing_ids(star: Star) -> DataFrame:
    """Requested ids that a dictionary doesn't have."""
    asked = star.spark.createDataFrame([(1,), (5,), (-7,), (999999999,)], "id int")
    return asked.join(star.table("part").select(F.col("p_partkey").alias("id")), "id", "left_anti")


# -- physiology and severity


@query("""SELECT user_id AS stay_key, """ + ", ".join(f"round(quantile_cont(value, 0.5) FILTER (WHERE event_type = '{t}' AND value BETWEEN {lo} AND {hi}), 6) AS {n}_median, round(quantile_cont(value, 0.75) FILTER (WHERE event_type = '{t}' AND value BETWEEN {lo} AND {hi}) - quantile_cont(value, 0.25) FILTER (WHERE event_type = '{t}' AND value BETWEEN {lo} AND {hi}), 6) AS {n}_iqr, count(*) FILTER (WHERE event_type = '{t}' AND value BETWEEN {lo} AND {hi})::BIGINT AS {n}_n" for n, t, lo, hi in (("hr", "click", 20, 250), ("map", "view", 20, 200), ("cuff", "error", 20, 200))) + " FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE (event_type = 'click' AND value BETWEEN 20 AND 250) OR (event_type IN ('view', 'error') AND value BETWEEN 20 AND 200)) > 0")
def physiology_summary(star: Star) -> DataFrame:
    """Median, IQR and count of three signals; stays with any of them. One aggregation stands for the outer joins."""
    aggs, any_ = [], F.lit(False)
    for n, t, lo, hi in (("hr", "click", 20, 250), ("map", "view", 20, 200), ("cuff", "error", 20, 200)):
        good = (F.col("item") == t) & F.col("value").between(lo, hi)
        any_ = any_ | good
        v = F.when(good, F.col("value"))
        aggs += [F.round(F.percentile(v, F.lit(0.5)), 6).alias(f"{n}_median"), F.round(F.percentile(v, F.lit(0.75)) - F.percentile(v, F.lit(0.25)), 6).alias(f"{n}_iqr"), F.count(v).alias(f"{n}_n")]
    return star.clock().where(any_).groupBy("stay_key").agg(*aggs)


#: Vital signs: stand-in item, admissible range, the scored tail and, for both tails, the centre.
VITALS = {"hr": ("click", 20, 250, "upper", None), "map": ("view", 20, 200, "lower", None), "rr": ("error", 2, 80, "upper", None), "temp": ("purchase", 25, 45, "both", 37.2)}


@query("""WITH measured AS (
  SELECT user_id AS stay_key, event_type, CASE WHEN event_type = 'purchase' THEN (value - 32) * 5 / 9 ELSE value END AS x FROM events),
vital AS (
  SELECT stay_key,
    min(x) FILTER (WHERE event_type = 'click' AND x BETWEEN 20 AND 250) AS hr_min, max(x) FILTER (WHERE event_type = 'click' AND x BETWEEN 20 AND 250) AS hr_max,
    min(x) FILTER (WHERE event_type = 'view' AND x BETWEEN 20 AND 200) AS map_min, max(x) FILTER (WHERE event_type = 'view' AND x BETWEEN 20 AND 200) AS map_max,
    min(x) FILTER (WHERE event_type = 'error' AND x BETWEEN 2 AND 80) AS rr_min, max(x) FILTER (WHERE event_type = 'error' AND x BETWEEN 2 AND 80) AS rr_max,
    min(x) FILTER (WHERE event_type = 'purchase' AND x BETWEEN 25 AND 45) AS t_min, max(x) FILTER (WHERE event_type = 'purchase' AND x BETWEEN 25 AND 45) AS t_max
  FROM measured GROUP BY 1),
coma AS (
  SELECT stay_key, min(total) AS gcs FROM (
    SELECT user_id AS stay_key, date_trunc('day', ts) AS d, sum(value) AS total FROM events WHERE event_type = 'signup' GROUP BY 1, 2 HAVING count(*) = 3) GROUP BY 1),
urine AS (
  SELECT user_id AS stay_key, sum(CASE WHEN event_type = 'error' AND value > 0 THEN -value ELSE value END) AS volume FROM events WHERE event_type IN ('view', 'error') GROUP BY 1)
SELECT stay_key, hr_max AS hr_worst, map_min AS map_worst, rr_max AS rr_worst,
  round(CASE WHEN abs(t_max - 37.2) >= abs(37.2 - t_min) THEN t_max ELSE t_min END, 6) AS temp_worst, round(gcs, 6) AS gcs_worst, round(volume, 6) AS urine_24h,
  hr_min, hr_max, map_min, map_max, rr_min, rr_max, round(t_min, 6) AS temp_min, round(t_max, 6) AS temp_max
FROM vital FULL JOIN coma USING (stay_key) LEFT JOIN urine USING (stay_key)
WHERE hr_min IS NOT NULL OR map_min IS NOT NULL OR rr_min IS NOT NULL OR t_min IS NOT NULL OR gcs IS NOT NULL""")
def severity_components(star: Star) -> DataFrame:
    """For each stay the value on each vital sign's scored tail, the lowest complete coma score, the signed volume, and raw ends.

    Stays with a vital sign or a coma score; the volume is null where none was recorded.
    """
    e = star.clock()
    value, aggs, worst = F.col("value"), [], []
    for name, (item, lo, hi, tail, centre) in VITALS.items():
        x = S.fahrenheit_to_celsius(value) if name == "temp" else value
        good = F.when(F.col("item") == item, S.range_null(x, lo, hi))
        aggs += [F.min(good).alias(f"{name}_min"), F.max(good).alias(f"{name}_max")]
        worst.append(S.tail_value(F.col(f"{name}_min"), F.col(f"{name}_max"), tail, centre).alias(f"{name}_worst"))
    volume = F.when(F.col("item").isin("view", "error"), S.signed(value, F.col("item") == "error"))
    vital = e.groupBy("stay_key").agg(*aggs, F.round(F.sum(volume), 6).alias("urine_24h"))
    days = e.where("item = 'signup'").groupBy("stay_key", F.date_trunc("day", "ts").alias("d")).agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    coma = days.where("n = 3").groupBy("stay_key").agg(F.round(F.min("total"), 6).alias("gcs_worst"))
    ends = [f"{name}_{end}" for name in VITALS for end in ("min", "max")]
    found = vital.join(coma, "stay_key", "left").where(" or ".join(f"{c} is not null" for c in [*ends, "gcs_worst"]))
    return _rounded(found.select("stay_key", *worst, "gcs_worst", "urine_24h", *ends), "temp_worst", "temp_min", "temp_max")


_CLEANUP = """WITH raw AS (SELECT c_custkey::BIGINT AS id, (c_custkey % 5 - 1)::DOUBLE AS eyes, (c_custkey % 7 - 1)::DOUBLE AS motor, (c_nationkey % 6 - 1)::DOUBLE AS verbal,
  c_acctbal::DOUBLE / 10 AS hr, (c_custkey % 3 - 1)::DOUBLE AS vent, (c_nationkey % 3 - 1)::DOUBLE AS intubated FROM customer),
a AS (SELECT id, CASE WHEN eyes >= 0 THEN eyes END AS e, CASE WHEN motor >= 0 THEN motor END AS m, CASE WHEN verbal >= 0 THEN verbal END AS v,
  CASE WHEN hr >= 0 THEN hr END AS hr, CASE WHEN vent >= 0 THEN vent END AS ve, CASE WHEN intubated >= 0 THEN intubated END AS i FROM raw)
SELECT id, e + m + v AS gcs, CASE WHEN hr BETWEEN 20 AND 250 THEN hr END AS hr, CASE WHEN ve IS NULL AND i IS NULL THEN NULL WHEN coalesce(ve = 1, false) OR coalesce(i = 1, false) THEN 1 ELSE 0 END::INT AS ventilated FROM a"""


@query(_CLEANUP, "severity_cleanup")
@query(_CLEANUP)
def severity_cleanup_table(star: Star) -> DataFrame:
    """Coma score, heart rate and ventilation of rows with negative sentinels."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    raw = {"eyes": key % 5 - 1, "motor": key % 7 - 1, "verbal": nation % 6 - 1, "hr": F.col("c_acctbal").cast("double") / 10, "vent": key % 3 - 1, "intubated": nation % 3 - 1}
    aps = star.table("customer").select(key.cast("long").alias("id"), *[S.sentinel_null(c.cast("double")).alias(n) for n, c in raw.items()])
    gcs = S.complete_sum(*[F.col(c) for c in ("eyes", "motor", "verbal")])
    return aps.select("id", gcs.alias("gcs"), S.range_null(F.col("hr"), 20, 250).alias("hr"), S.any_one(F.col("vent"), F.col("intubated")).alias("ventilated"))


# -- association with the hour


def _admissions(star: Star) -> DataFrame:
    """Cohort with the bin of its first event's hour, a low flag over the cohort, and a covariate."""
    hours = star.clock().groupBy("stay_key").agg(F.hour(F.min("ts")).alias("hour"), F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    c = hours.join(star.stays(), "stay_key").withColumn("bin", S.bin_2h(F.col("hour")))
    cut = A.quantile(c, "n", [0.5]).select("cut")
    stats = c.agg(F.avg("mean_value").alias("mu"), F.stddev_samp("mean_value").alias("sd"))
    return c.crossJoin(F.broadcast(cut)).crossJoin(F.broadcast(stats)).withColumns({"low": F.col("n") <= F.col("cut"), "z": (F.col("mean_value") - F.col("mu")) / F.col("sd")})


def _specifications(star: Star) -> DataFrame:
    """Rows of the four models (specification): {contaminated, clean} exposure x {all stays, completed 24h}.

    Contaminated counts are the monitor stream's, clean ones the nurse stream's, both in the window; stays have both
    and a clock hour. The low flag is a count up to the 10th percentile of its own subset. z, comorbid_z and chapters_z
    are z-scores over all these stays.
    """
    hours = star.clock().groupBy("stay_key").agg(F.hour(F.min("ts")).alias("hour"), F.avg("value").alias("mean_value"))
    count = lambda events, name: E.in_window(events).groupBy("stay_key").agg(F.count("*").alias(name))
    c = hours.where("hour is not null").join(star.stays(), "stay_key").join(star.people(), "stay_key").join(count(star.monitor(), "contaminated"), "stay_key").join(count(star.nurse(), "clean"), "stay_key")
    scores = {"z": "mean_value", "comorbid_z": "comorbid", "chapters_z": "chapters"}
    stats = c.agg(*(f(x).alias(f"{z}_{n}") for z, x in scores.items() for f, n in ((F.avg, "mu"), (F.stddev_samp, "sd"))))
    dressed = c.crossJoin(F.broadcast(stats)).withColumns({"bin": S.bin_2h(F.col("hour"))} | {z: (F.col(x) - F.col(f"{z}_mu")) / F.col(f"{z}_sd") for z, x in scores.items()})
    keep = ["stay_key", "hospital", "unittype", "gender", "year_group", "bin", *scores]
    long = dressed.unpivot([*keep, "completed"], ["contaminated", "clean"], "exposure", "records")
    subsets = F.when(F.col("completed"), F.array(F.lit("all stays"), F.lit("completed 24h"))).otherwise(F.array(F.lit("all stays")))
    each = long.withColumn("restriction", F.explode(subsets)).select(*keep, F.concat_ws(" / ", "exposure", "restriction").alias("specification"), "records")
    cuts = A.quantile(each, "records", [0.1], ("specification",)).select("specification", "cut")
    return each.join(F.broadcast(cuts), "specification").withColumn("low", F.col("records") <= F.col("cut"))


_ODDS = "round(exp(b), 6) AS odds_ratio, round(exp(b - 1.959963984540054 * se), 6) AS lo, round(exp(b + 1.959963984540054 * se), 6) AS hi"


def _bins(odds: DataFrame) -> DataFrame:
    """The odds ratios of the bins, named as such."""
    return odds.where("factor = 'bin'").select("model", F.col("level").alias("bin"), "n", "odds_ratio", "lo", "hi", "p", "converged")


@query()
def logit_hourly(star: Star) -> DataFrame:
    """Odds of a low count by hour, given age, gender, comorbidities, chapters, year group and unit type."""
    factors = {"bin": "00-02", "gender": None, "year_group": None, "unittype": None}
    return _bins(L.odds_ratios(_specifications(star), "low", factors, ("z", "comorbid_z", "chapters_z"), model="specification"))


@query()
def logit_cluster(star: Star) -> DataFrame:
    """Odds of a low count by hour, given age, gender and unit type, with errors robust to hospitals."""
    factors = {"bin": "00-02", "gender": None, "unittype": None}
    return _bins(L.odds_ratios(_specifications(star), "low", factors, ("z",), cluster="hospital", model="specification"))


@query()
def logit_by_unit(star: Star) -> DataFrame:
    """Negative control: a model of the clean exposure in completed stays for every unit with enough stays, low stays and bins.

    The threshold is that of all units together.
    """
    a = _specifications(star).where("specification = 'clean / completed 24h'")
    ok = a.groupBy("unittype").agg(F.count("*").alias("m"), F.sum(F.col("low").cast("int")).alias("lows"), F.countDistinct("bin").alias("bins")).where("m >= 10 and lows >= 2 and bins >= 3")
    return _bins(L.odds_ratios(a.join(ok.select("unittype"), "unittype", "left_semi"), "low", {"bin": "00-02", "gender": None}, ("z", "comorbid_z"), model="unittype"))


def _solved(matrix: str, k: str) -> str:
    """Gauss-Jordan elimination of the first k columns, as nested lambdas over a list of rows."""
    pivot = "p[1][1]::INT"
    other = f"list_transform(row, lambda v, j: v - row[{pivot}] / a[{pivot}][{pivot}] * a[{pivot}][j])"
    own = f"list_transform(row, lambda v: v / a[{pivot}][{pivot}])"
    return f"list_reduce(list_prepend({matrix}, list_transform(range(1, {k} + 1), lambda p: [[p::DOUBLE]])), lambda a, p: list_transform(a, lambda row, i: CASE WHEN i = {pivot} THEN {own} ELSE {other} END))"


def _logit_sql(cluster: bool) -> str:
    """Newton's method in a recursive query, with dense normal equations."""
    pieces = "SELECT c.id, c.x, c.y, 1 / (1 + exp(-list_dot_product(c.x, f.beta))) AS p, f.step, f.beta FROM fit f, design c"
    sums = f"SELECT step, beta, i, j, sum(x[i] * p * (1 - p) * x[j]) AS h, sum(x[i] * (y - p)) AS g FROM ({pieces}), (SELECT unnest(range(1, k + 1)) AS i FROM size), (SELECT unnest(range(1, k + 1)) AS j FROM size)"
    rows = lambda own: f"SELECT step, beta, i, list(h ORDER BY j) || {own} AS line FROM ({{}}) GROUP BY step, beta, i"
    unit = "list_transform(range(1, len(beta) + 1), lambda c: CASE WHEN c = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
    newton = rows("[any_value(g)]").format(sums + " WHERE step < 12 GROUP BY step, beta, i, j")
    last = rows(unit).format(sums + " WHERE step = 12 GROUP BY step, beta, i, j")
    variance = "inverse[i][len(beta) + i]"
    if cluster:
        scores = f"SELECT hospital, i, sum(x[i] * (y - p)) AS s FROM ({pieces} WHERE step = 12) JOIN (SELECT id, hospital FROM low) USING (id), (SELECT unnest(range(1, k + 1)) AS i FROM size) GROUP BY hospital, i"
        pulls = f"SELECT t.i, sum(pull ** 2) AS v FROM terms t, LATERAL (SELECT hospital, sum(inverse[t.i][k + c.i] * s) AS pull FROM ({scores}) c, final, size GROUP BY hospital) GROUP BY t.i"
        variance = f"(SELECT v FROM ({pulls}) q WHERE q.i = t.i) * (SELECT count(DISTINCT hospital) / (count(DISTINCT hospital) - 1.0) * (count(*) - 1.0) / (count(*) - any_value(k)) FROM low, size)"
    return f"""WITH RECURSIVE {STAYS}, {NURSE}, counts AS (SELECT stay_key, count(*) AS n, min(offset_min) AS first FROM nurse GROUP BY 1),
told AS (SELECT stay_key AS id, hospital, n, printf('%02d-%02d', first % 24 // 2 * 2, first % 24 // 2 * 2 + 2) AS bin, CASE WHEN stay_key % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
  unittype, 'group ' || (stay_key // 7 % 4) AS year_group, los FROM counts JOIN stays USING (stay_key)),
low AS (SELECT *, (n <= (SELECT quantile_cont(n, 0.1) FROM told))::INT::DOUBLE AS y, (los - (SELECT avg(los) FROM told)) / (SELECT stddev_samp(los) FROM told) AS z FROM told),
named AS (SELECT DISTINCT 0 AS f, bin AS level FROM low UNION SELECT DISTINCT 1, gender FROM low UNION SELECT DISTINCT 2, unittype FROM low UNION SELECT DISTINCT 3, year_group FROM low),
terms AS (SELECT (row_number() OVER (ORDER BY f, level) + 2)::INT AS i, f, level FROM (SELECT *, CASE WHEN f = 0 THEN '18-20' ELSE min(level) OVER (PARTITION BY f) END AS base FROM named) WHERE level <> base),
size AS (SELECT (count(*) + 2)::INT AS k FROM terms),
design AS (SELECT id, any_value(y) AS y, [1.0::DOUBLE, any_value(z)] || list(CASE WHEN level = CASE f WHEN 0 THEN bin WHEN 1 THEN gender WHEN 2 THEN unittype ELSE year_group END THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY i) AS x FROM low, terms GROUP BY id),
fit AS (SELECT 0 AS step, list_transform(range(k), lambda i: 0.0::DOUBLE) AS beta FROM size
  UNION ALL SELECT step + 1, list_transform(beta, lambda b, i: b + solved[i][len(beta) + 1]) FROM (
    SELECT step, beta, {_solved("list(line ORDER BY i)", "len(beta)")} AS solved FROM ({newton}) GROUP BY step, beta)),
final AS (SELECT beta, {_solved("list(line ORDER BY i)", "len(beta)")} AS inverse FROM ({last}) GROUP BY step, beta),
found AS (SELECT f, level, beta[i] AS b, sqrt({variance}) AS se FROM terms t, final)
SELECT CASE f WHEN 0 THEN 'bin' WHEN 1 THEN 'gender' WHEN 2 THEN 'unittype' ELSE 'year_group' END AS factor, level, (SELECT count(*) FROM low)::BIGINT AS n, {_ODDS} FROM found"""


def _covariates(star: Star, **options) -> DataFrame:
    """Odds of a low nurse count by the hour of the first record, given age, gender, unit type and year group."""
    counts = E.in_window(star.nurse()).groupBy("stay_key").agg(F.count("*").alias("n"), F.min("offset_min").alias("first"))
    c = counts.join(star.stays(), "stay_key").join(star.people(), "stay_key").withColumn("bin", S.bin_2h(F.col("first") % 24))
    stats = c.agg(F.avg("los").alias("mu"), F.stddev_samp("los").alias("sd"))
    cut = A.quantile(c, "n", [0.1]).select("cut")
    low = c.crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(cut)).withColumns({"low": F.col("n") <= F.col("cut"), "z": (F.col("los") - F.col("mu")) / F.col("sd")})
    found = L.odds_ratios(low, "low", {"bin": "18-20", "gender": None, "unittype": None, "year_group": None}, ("z",), **options)
    return _rounded(found.where("level is not null").select("factor", "level", "n", "odds_ratio", "lo", "hi"), "odds_ratio", "lo", "hi")


@query(_logit_sql(False))
def logit_covariates(star: Star) -> DataFrame:
    """Four factors and a number, every factor's odds ratios."""
    return _covariates(star)


@query(_logit_sql(True))
def logit_covariates_cluster(star: Star) -> DataFrame:
    """The same with errors robust to hospitals."""
    return _covariates(star, cluster="hospital")


_SEGMENT = """WITH rows AS (SELECT c_mktsegment AS bin, c_nationkey AS cluster, (c_acctbal < 1000)::INT::DOUBLE AS y FROM customer),
fit AS (SELECT bin, count(*)::DOUBLE AS n, avg(y) AS p FROM rows GROUP BY 1),
ref AS (SELECT n AS n0, p AS p0 FROM fit WHERE bin = 'AUTOMOBILE'),
each AS (SELECT bin, ln(p / (1 - p)) - ln(p0 / (1 - p0)) AS b, n * p * (1 - p) AS h, n0 * p0 * (1 - p0) AS h0 FROM fit, ref WHERE bin <> 'AUTOMOBILE')"""
def _segments(star: Star) -> DataFrame:
    return star.table("customer").select(F.col("c_mktsegment").alias("bin"), F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") < 1000).alias("low"))


@query(f"{_SEGMENT} SELECT bin, (SELECT count(*) FROM rows)::BIGINT AS n, {_ODDS} FROM (SELECT *, sqrt(1 / h + 1 / h0) AS se FROM each)")
def logit_segments(star: Star) -> DataFrame:
    """A logistic model of one category, whose coefficients and Wald errors have a closed form in SQL."""
    found = L.odds_ratios(_segments(star), "low", {"bin": "AUTOMOBILE"})
    return _rounded(found.select(F.col("level").alias("bin"), "n", "odds_ratio", "lo", "hi"), "odds_ratio", "lo", "hi")


@query(f"""{_SEGMENT}, scores AS (SELECT r.cluster, r.bin, sum(r.y - f.p) AS s FROM rows r JOIN fit f ON r.bin = f.bin GROUP BY 1, 2),
pulls AS (SELECT e.bin, e.b, c.cluster, coalesce(a.s, 0) / e.h - coalesce(z.s, 0) / e.h0 AS pull FROM each e CROSS JOIN (SELECT DISTINCT cluster FROM rows) c
  LEFT JOIN scores a ON a.bin = e.bin AND a.cluster = c.cluster LEFT JOIN scores z ON z.bin = 'AUTOMOBILE' AND z.cluster = c.cluster),
small AS (SELECT count(DISTINCT cluster)::DOUBLE AS g, count(*)::DOUBLE AS n, count(DISTINCT bin)::DOUBLE AS k FROM rows)
SELECT bin, any_value(n)::BIGINT AS n, {_ODDS.replace("exp(b", "exp(any_value(b)").replace("se)", "any_value(se))")} FROM (
  SELECT bin, b, n, sqrt(sum(pull * pull) OVER (PARTITION BY bin) * g / (g - 1) * (n - 1) / (n - k)) AS se FROM pulls, small) GROUP BY bin""")
def logit_segments_cluster(star: Star) -> DataFrame:
    """The same with errors robust to clusters."""
    found = L.odds_ratios(_segments(star), "low", {"bin": "AUTOMOBILE"}, cluster="nation")
    return _rounded(found.select(F.col("level").alias("bin"), "n", "odds_ratio", "lo", "hi"), "odds_ratio", "lo", "hi")


_PEAK = """WITH a AS (SELECT user_id, hour(min(ts)) AS h, count(*) AS n FROM events GROUP BY 1), b AS (SELECT r_name AS database, h // 2 AS k, n <= (SELECT quantile_cont(n, 0.5) FROM a) AS low FROM a
JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
s AS (SELECT database, k, round(avg(low::INT), 9)::DOUBLE AS share FROM b GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY database ORDER BY share DESC, k) AS rn FROM s)"""


@query(_PEAK + " SELECT database, printf('%02d-%02d', (2 * k)::INT, (2 * k + 2)::INT) AS peak, round(share, 6) AS share, 2 * k < 14 AS before_14 FROM r WHERE rn = 1")
def peak_bin(star: Star) -> DataFrame:
    """The bin with the largest share of low stays in each group; ties go to the earlier one."""
    bins = _admissions(star).groupBy("database", "bin").agg(F.round(F.avg(F.col("low").cast("double")), 9).alias("share"), F.min(F.floor(F.col("hour") / 2)).alias("k"))
    top = bins.groupBy("database").agg(F.max(F.struct("share", -F.col("k"), "bin")).alias("t"))
    return top.select("database", F.col("t.bin").alias("peak"), F.round("t.share", 6).alias("share"), (F.substring("t.bin", 1, 2).cast("int") < 14).alias("before_14"))


_HOSPITAL_PEAKS = f"""WITH {STAYS}, {NURSE}, {MONITOR}, admitted AS (SELECT user_id AS stay_key, hour(min(ts)) // 2 AS k FROM events GROUP BY 1),
clean AS (SELECT stay_key, count(*) AS n FROM nurse GROUP BY 1),
done AS (SELECT hospital, k, n FROM admitted JOIN stays USING (stay_key) JOIN clean USING (stay_key) WHERE completed AND stay_key IN (SELECT stay_key FROM monitor)),
flagged AS (SELECT hospital, k, (n <= (SELECT quantile_cont(n, 0.1) FROM done))::INT AS low, count(*) OVER (PARTITION BY hospital) AS n_stays FROM done),
rates AS (SELECT hospital, k, n_stays, avg(low) AS rate FROM flagged WHERE n_stays >= 3 GROUP BY 1, 2, 3),
peaks AS (SELECT hospital, n_stays::BIGINT AS n_stays, (2 * k)::INT AS peak_hour, round(rate, 6) AS peak_rate FROM (
  SELECT *, row_number() OVER (PARTITION BY hospital ORDER BY round(rate, 9) DESC, k) AS place FROM rates) WHERE place = 1)"""


@query(_HOSPITAL_PEAKS + " SELECT * FROM peaks")
def hospital_peaks(star: Star) -> DataFrame:
    """Each hospital's admission bin with the largest share of low clean counts, completed stays only; ties go to the earlier bin."""
    s = _specifications(star).where("specification = 'clean / completed 24h'").withColumn("hour", F.substring("bin", 1, 2).cast("int"))
    rates = s.groupBy("hospital", "hour").agg(F.count("*").alias("m"), F.round(F.avg(F.col("low").cast("double")), 9).alias("rate"))
    top = rates.groupBy("hospital").agg(F.sum("m").alias("n_stays"), F.max(F.struct("rate", (-F.col("hour")).alias("h"))).alias("t")).where("n_stays >= 3")
    return top.select("hospital", "n_stays", (-F.col("t.h")).alias("peak_hour"), F.round("t.rate", 6).alias("peak_rate"))


@query(_HOSPITAL_PEAKS + " SELECT count(*)::BIGINT AS hospitals, round(avg((peak_hour < 14)::INT), 6)::DOUBLE AS share_early FROM peaks")
def early_peak_share(star: Star) -> DataFrame:
    """Share of hospitals whose peak lies between 00:00 and 14:00."""
    return hospital_peaks(star).agg(F.count("*").alias("hospitals"), F.round(F.avg((F.col("peak_hour") < 14).cast("double")), 6).alias("share_early"))


@query(COHORT + " " + _union([f"SELECT '{m}' AS metric, (SELECT round(corr(ln(n_records), {m}::DOUBLE) ** 2, 6) FROM c WHERE {m} IS NOT NULL) AS r2 FROM (SELECT 1)" for m in M8]))
def residual_r2(star: Star) -> DataFrame:
    """Share of each metric's variance that record density explains (inferred: the study's own script is absent)."""
    long = V.long_metrics(nurse_cohort(star).withColumn("x", F.log("n_records")), M8, ["x"])
    return long.groupBy("metric").agg(F.round(F.pow(F.corr("x", "y"), F.lit(2.0)), 6).alias("r2"))
