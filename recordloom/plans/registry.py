"""Registration of queries and the SQL that all of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordloom.sources.tables import Star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of Star as a query of (spark, sf_dir)."""

    def register(f: Callable[[Star], DataFrame]):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries named {key}")
        QUERIES[key] = lambda spark, sf_dir: f(Star(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[key] = sql
        return f

    return register


STAYS = """stays AS (
  SELECT c_custkey AS stay_key, r_name AS database, n_name AS hospital, c_mktsegment AS unittype,
         n_name || ':' || c_mktsegment AS unit_id, c_acctbal AS los, c_acctbal >= 0 AS completed
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def offset(date: str) -> str:
    return f"date_diff('day', DATE '1995-01-01', CAST({date} AS DATE))::INT"


NURSE = f"nurse AS (SELECT * FROM (SELECT o_custkey AS stay_key, {offset('o_orderdate')} AS offset_min FROM orders) WHERE offset_min >= 0 AND offset_min < 1440)"
MONITOR = f"monitor AS (SELECT * FROM (SELECT o_custkey AS stay_key, {offset('l_shipdate')} AS offset_min FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE offset_min >= 0 AND offset_min < 1440)"


def metrics(source: str, name: str) -> str:
    """A common table expression: metrics of each stay in an event table."""
    return f"""{name} AS (
  SELECT stay_key, count(*) AS n_records, min(offset_min) / 60.0::DOUBLE AS t_first_h, quantile_cont(gap, 0.5)::DOUBLE AS median_interval_min,
         (quantile_cont(gap, 0.75) - quantile_cont(gap, 0.25))::DOUBLE AS iqr_interval_min, max(gap)::DOUBLE AS max_interval_min,
         sum(CASE WHEN gap IS NULL THEN NULL WHEN gap > 30 THEN 1 ELSE 0 END)::BIGINT AS n_gaps_gt30m,
         sum(CASE WHEN gap IS NULL THEN NULL WHEN gap > 120 THEN 1 ELSE 0 END)::BIGINT AS n_gaps_gt2h,
         sum(CASE WHEN gap IS NULL THEN NULL WHEN gap > 240 THEN 1 ELSE 0 END)::BIGINT AS n_gaps_gt4h,
         sum(CASE WHEN gap IS NULL THEN NULL WHEN gap > 120 THEN gap ELSE 0 END) / 1440.0::DOUBLE AS frac_time_in_gaps
  FROM (SELECT *, offset_min - lag(offset_min) OVER (PARTITION BY stay_key ORDER BY offset_min) AS gap FROM {source})
  GROUP BY stay_key)"""


def cohort(source: str, name: str) -> str:
    return f"{name} AS (SELECT m.*, s.* EXCLUDE (stay_key) FROM {source} m JOIN stays s ON m.stay_key = s.stay_key WHERE s.completed AND m.n_records >= 3)"


#: Nurse-stream cohort as table c; both streams' as c and d.
COHORT = f"WITH {STAYS}, {NURSE}, {metrics('nurse', 'nm')}, {cohort('nm', 'c')}"
BOTH = f"{COHORT}, {MONITOR}, {metrics('monitor', 'mm')}, {cohort('mm', 'd')}"


def eta2_sql(value: str, group: str, table: str, least: int = 10) -> str:
    """A scalar subquery."""
    return f"""(SELECT CASE WHEN max(rows) >= {least} AND max(sst) > 0 THEN sum(CASE WHEN g IS NOT NULL THEN n * (mean - grand) ** 2 END) / max(sst) END FROM (
    SELECT {group} AS g, count({value}) AS n, avg({value}::DOUBLE) AS mean, any_value(grand) AS grand, any_value(rows) AS rows, any_value(sst) AS sst
    FROM {table} CROSS JOIN (SELECT avg({value}::DOUBLE) AS grand, count({value}) AS rows, var_pop({value}::DOUBLE) * count({value}) AS sst FROM {table})
    WHERE {value} IS NOT NULL GROUP BY {group}))"""
