"""Scans, predicates, scalar functions, joins, aggregates, windows and sorts, each as a small query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions import scalars as S
from recordloom.operators import agreement as A
from recordloom.operators import events as E
from recordloom.operators.ranges import numbered, sums_before
from recordloom.plans.registry import MONITOR, NURSE, STAYS, metrics, query
from recordloom.sources import scratch, sinks, tables
from recordloom.sources.tables import Star


def _folder(star: Star, name: str) -> str:
    """A new path in the shared folder."""
    return scratch.new_path(star.spark, name)


# -- scans and sinks


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def scan_csv(star: Star) -> DataFrame:
    path = _folder(star, "nation") + ".csv"
    sinks.write_csv(star.table("nation"), path)
    return tables.scan(star.spark, path, "n_nationkey long, n_name string")


@query("SELECT column_name FROM (VALUES ('event_id'), ('ts'), ('user_id'), ('event_type'), ('value'), ('props')) AS t(column_name)")
def schema_probe(star: Star) -> DataFrame:
    return star.spark.createDataFrame([(c,) for c in star.table("events").columns], "column_name string")


@query("SELECT r_regionkey::INT AS r_regionkey, r_name FROM region")
def sink_roundtrip(star: Star) -> DataFrame:
    path = _folder(star, "region") + ".csv"
    sinks.write_csv(star.table("region"), path)
    return tables.scan(star.spark, path, "r_regionkey int, r_name string")


@query("SELECT n_nationkey::INT AS n_nationkey, n_name FROM nation")
def table_locator(star: Star) -> DataFrame:
    """The first of several names that the folder has."""
    path = tables.locate(star.spark, star.folder, ["country.csv.gz", "nation.parquet", "region.parquet"])
    return star.spark.read.parquet(path).select("n_nationkey", "n_name")


@query("SELECT event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events WHERE value >= 100 GROUP BY 1")
def event_scan(star: Star) -> DataFrame:
    """A whole event table by way of CSV: declared columns, filter and aggregation in one scan."""
    path = _folder(star, "events") + ".csv"
    sinks.write_csv(star.table("events").select("event_id", "event_type", "value"), path)
    e = tables.scan(star.spark, path, "event_type string, value double").where("value >= 100")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT p_partkey, p_size::INT AS p_size FROM part")
def parquet_cache(star: Star) -> DataFrame:
    """Written once: the second call, with other rows, finds the copy and keeps it."""
    path, part = _folder(star, "part"), star.table("part").select("p_partkey", "p_size")
    tables.to_parquet(part, path)
    return tables.to_parquet(part.limit(1), path)


@query("SELECT s_suppkey::BIGINT AS s_suppkey, s_acctbal FROM supplier")
def csv_cache(star: Star) -> DataFrame:
    """A CSV copy that is written unless it is there."""
    path = _folder(star, "supplier") + ".csv"
    for rows in (star.table("supplier"), star.table("supplier").limit(1)):
        if not tables.exists(star.spark, path):
            sinks.write_csv(rows, path)
    return tables.scan(star.spark, path, "s_suppkey long, s_acctbal double")


@query("SELECT 'Regions' AS line UNION ALL SELECT '' UNION ALL SELECT 'r_regionkey' || chr(9) || 'r_name' UNION ALL SELECT r_regionkey || chr(9) || r_name FROM region")
def text_report(star: Star) -> DataFrame:
    path = _folder(star, "report")
    sinks.write_report(star.table("region"), path, "Regions", [F.col("r_regionkey")])
    return star.spark.read.text(path).select(F.col("value").alias("line"))


@query("""SELECT (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) + 2)::BIGINT AS place, o_orderkey || chr(9) || o_orderstatus AS line FROM orders
UNION ALL SELECT 0, 'Orders by price' UNION ALL SELECT 1, '' UNION ALL SELECT 2, 'o_orderkey' || chr(9) || 'o_orderstatus'""")
def text_report_ordered(star: Star) -> DataFrame:
    """A report of a large table in a global order, many files wide, read back line by line in the order of its files."""
    path = _folder(star, "report")
    orders = star.table("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    sinks.write_report(orders, path, "Orders by price", [F.desc("o_totalprice"), F.col("o_orderkey")], ["o_orderkey", "o_orderstatus"])
    return sinks.read_report(star.spark, path).select("place", F.col("value").alias("line"))


@query("SELECT o_orderkey, o_orderstatus AS status, NULL::VARCHAR AS ward FROM orders")
def optional_column(star: Star) -> DataFrame:
    """A column the table has, and one that it hasn't."""
    o = star.table("orders")
    return o.select("o_orderkey", tables.optional(o, "o_orderstatus").alias("status"), tables.optional(o, "ward").alias("ward"))


# -- projections and predicates


@query("SELECT o_orderkey::INT AS order_id, o_custkey::INT AS stay_id FROM orders")
def cast_integers(star: Star) -> DataFrame:
    return star.table("orders").select(F.col("o_orderkey").cast("int").alias("order_id"), F.col("o_custkey").cast("int").alias("stay_id"))


@query("SELECT c_custkey, 'star' AS db, 'nation-' || c_nationkey || ':' || c_mktsegment AS unit_id FROM customer")
def label_columns(star: Star) -> DataFrame:
    unit = F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string"), F.lit(":"), "c_mktsegment")
    return star.table("customer").select("c_custkey", F.lit("star").alias("db"), unit.alias("unit_id"))


@query("SELECT user_id, round(ln(count(*)), 9) AS log_n FROM events GROUP BY 1")
def log_records(star: Star) -> DataFrame:
    return star.table("events").groupBy("user_id").agg(F.round(F.log(F.count("*")), 9).alias("log_n"))


@query("SELECT l_orderkey, l_linenumber, round_even(l_quantity / 4, 0) AS quarter FROM lineitem")
def half_even_round(star: Star) -> DataFrame:
    return star.table("lineitem").select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 4, 0).alias("quarter"))


@query("SELECT user_id, count(CASE WHEN event_type = 'view' THEN 1 END) / greatest(count(CASE WHEN event_type = 'error' THEN 1 END), 1)::DOUBLE AS ratio FROM events GROUP BY 1")
def floored_divisor(star: Star) -> DataFrame:
    n = lambda t: F.count(F.when(F.col("event_type") == t, 1))
    return star.table("events").groupBy("user_id").agg((n("view") / F.greatest(n("error"), F.lit(1))).alias("ratio"))


@query("SELECT user_id AS stay_key, event_type AS item, value FROM events")
def project_rename(star: Star) -> DataFrame:
    return star.table("events").select(F.col("user_id").alias("stay_key"), F.col("event_type").alias("item"), "value")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_in(star: Star) -> DataFrame:
    return star.table("orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def filter_eq(star: Star) -> DataFrame:
    return star.table("orders").where(F.col("o_orderstatus") == "F").select("o_orderkey")


@query("SELECT event_id, value FROM events WHERE value BETWEEN 20 AND 150")
def filter_between(star: Star) -> DataFrame:
    return star.table("events").where(F.col("value").between(20, 150)).select("event_id", "value")


@query(f"WITH {NURSE} SELECT stay_key, offset_min FROM nurse")
def window_filter(star: Star) -> DataFrame:
    return E.in_window(star.nurse())


@query("SELECT c_custkey, bal FROM (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS bal FROM customer) WHERE bal IS NOT NULL")
def drop_nulls(star: Star) -> DataFrame:
    return star.table("customer").select("c_custkey", S.sentinel_null(F.col("c_acctbal")).alias("bal")).na.drop(subset=["bal"])


@query(r"SELECT p_partkey, p_type FROM part WHERE coalesce(regexp_matches(p_type, '(?i)\bstandard|promo\b'), false)")
def regex_filter(star: Star) -> DataFrame:
    return star.table("part").where(S.contains_any_case(F.col("p_type"), r"\bstandard|promo\b")).select("p_partkey", "p_type")


@query("SELECT p_partkey FROM part WHERE coalesce(regexp_matches(p_name, '(?i)green'), false) OR coalesce(regexp_matches(p_brand, '(?i)#1'), false)")
def regex_or_filter(star: Star) -> DataFrame:
    return star.table("part").where(S.contains_any_case(F.col("p_name"), "green") | S.contains_any_case(F.col("p_brand"), "#1")).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN (SELECT DISTINCT o_orderpriority FROM orders WHERE regexp_matches(o_orderpriority, '(?i)urgent|low'))")
def regex_semi(star: Star) -> DataFrame:
    orders = star.table("orders")
    names = orders.select("o_orderpriority").distinct().where(S.contains_any_case(F.col("o_orderpriority"), "urgent|low"))
    return orders.join(names, "o_orderpriority", "left_semi").select("o_orderkey")


_TEXTS = """(SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN o_orderpriority WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN ' ' || o_custkey || ' '
  WHEN 4 THEN o_custkey || 'd' WHEN 5 THEN '-.' || o_custkey WHEN 6 THEN o_custkey || '.e1' ELSE 'NaN' END AS text FROM orders)"""


@query(rf"SELECT id, CASE WHEN regexp_full_match(text, '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*') THEN try_cast(trim(text) AS DOUBLE) END AS value FROM {_TEXTS}")
def lenient_numeric(star: Star) -> DataFrame:
    key, customer = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    kinds = [F.col("o_orderpriority"), F.lit(""), F.lit(None), F.concat(F.lit(" "), customer, F.lit(" ")), F.concat(customer, F.lit("d")), F.concat(F.lit("-."), customer), F.concat(customer, F.lit(".e1")), F.lit("NaN")]
    texts = star.table("orders").select(key.alias("id"), F.get(F.array(*kinds), (key % 8).cast("int")).alias("text"))
    return texts.select("id", S.lenient_numeric(F.col("text")).alias("value"))


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS bal FROM customer")
def sentinel_null(star: Star) -> DataFrame:
    return star.table("customer").select("c_custkey", S.sentinel_null(F.col("c_acctbal")).alias("bal"))


@query("SELECT event_id, CASE WHEN value BETWEEN 2 AND 150 THEN value END AS value FROM events")
def range_null(star: Star) -> DataFrame:
    return star.table("events").select("event_id", S.range_null(F.col("value"), 2, 150).alias("value"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' END AS kind FROM customer")
def dict_map(star: Star) -> DataFrame:
    table = F.create_map(F.lit("BUILDING"), F.lit("B"), F.lit("MACHINERY"), F.lit("M"))
    return star.table("customer").select("c_custkey", F.try_element_at(table, F.col("c_mktsegment")).alias("kind"))


@query("SELECT event_id, date_diff('microsecond', first, ts)::DOUBLE / 6e7 AS minutes FROM events JOIN (SELECT user_id, min(ts) AS first FROM events GROUP BY user_id) USING (user_id)")
def elapsed_offset(star: Star) -> DataFrame:
    e = star.table("events")
    firsts = e.groupBy("user_id").agg(F.min("ts").alias("first"))
    return e.join(firsts, "user_id").select("event_id", S.elapsed_minutes(F.col("first"), F.col("ts")).alias("minutes"))


@query("SELECT event_id, hour(ts)::INT AS h, minute(ts)::INT AS m FROM events")
def clock_hour(star: Star) -> DataFrame:
    return star.table("events").select("event_id", F.hour("ts").alias("h"), F.minute("ts").alias("m"))


@query("SELECT user_id, round(avg(CASE WHEN minute(ts) < 5 THEN 1.0 ELSE 0.0 END), 8)::DOUBLE AS frac FROM events GROUP BY user_id")
def on_hour_frac(star: Star) -> DataFrame:
    return star.table("events").groupBy("user_id").agg(F.round(F.avg(S.on_the_hour(F.col("ts"))), 8).alias("frac"))


_BIN = "printf('%02d-%02d', (hour({0}) // 2 * 2)::INT, (hour({0}) // 2 * 2 + 2)::INT)"


@query(f"SELECT event_id, {_BIN.format('ts')} AS bin FROM events")
def bin_2h(star: Star) -> DataFrame:
    return star.table("events").select("event_id", S.bin_2h(F.hour("ts")).alias("bin"))


@query("""SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN hour(ts) WHEN 2 THEN NULL ELSE NULL END::INT AS h FROM events""")
def parse_time(star: Star) -> DataFrame:
    """Hours of texts: null, a time, only a number, or empty, in turn."""
    turn, time = F.col("event_id") % 4, F.date_format("ts", "HH:mm:ss")
    text = F.when(turn == 1, time).when(turn == 2, F.date_format("ts", "m")).when(turn == 3, F.lit(""))
    return star.table("events").select(F.col("event_id").alias("id"), S.time_hour(text).alias("h"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 90.0 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE c_custkey % 90 END::DOUBLE AS age FROM customer""")
def topcode_age(star: Star) -> DataFrame:
    """Ages as texts: top-coded, empty, null and plain ones."""
    turn = F.col("c_custkey") % 5
    text = F.when(turn == 0, F.lit("> 89")).when(turn == 1, F.lit("")).when(turn > 2, (F.col("c_custkey") % 90).cast("string"))
    return star.table("customer").select(F.col("c_custkey").alias("id"), S.topcoded(text).alias("age"))


@query("SELECT c_custkey, round((c_acctbal - mu) / sd, 6) AS z FROM customer, (SELECT avg(c_acctbal) AS mu, stddev_samp(c_acctbal) AS sd FROM customer)")
def zscore(star: Star) -> DataFrame:
    c = star.table("customer")
    stats = c.agg(F.avg("c_acctbal").alias("mu"), F.stddev_samp("c_acctbal").alias("sd"))  # one row
    return c.crossJoin(F.broadcast(stats)).select("c_custkey", F.round((F.col("c_acctbal") - F.col("mu")) / F.col("sd"), 6).alias("z"))


@query("SELECT event_id, round((value - 32) * 5 / 9, 8) AS celsius FROM events")
def temp_convert(star: Star) -> DataFrame:
    return star.table("events").select("event_id", F.round(S.fahrenheit_to_celsius(F.col("value")), 8).alias("celsius"))


@query("SELECT l_orderkey, round(sum(CASE WHEN l_returnflag = 'R' AND l_quantity > 0 THEN -l_quantity ELSE l_quantity END), 4) AS total FROM lineitem GROUP BY l_orderkey")
def signed_sum(star: Star) -> DataFrame:
    value = S.signed(F.col("l_quantity"), F.col("l_returnflag") == "R")
    return star.table("lineitem").groupBy("l_orderkey").agg(F.round(F.sum(value), 4).alias("total"))


@query("""SELECT user_id, hi AS worst_high, lo AS worst_low, CASE WHEN abs(hi - 75) >= abs(75 - lo) THEN hi ELSE lo END AS worst_far
FROM (SELECT user_id, min(value) AS lo, max(value) AS hi FROM events GROUP BY user_id)""")
def worst_value(star: Star) -> DataFrame:
    e = star.table("events").groupBy("user_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    return e.select("user_id", S.tail_value(lo, hi, "upper").alias("worst_high"), S.tail_value(lo, hi, "lower").alias("worst_low"), S.tail_value(lo, hi, "both", 75).alias("worst_far"))


_PAIRS = "(SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 2 END::INT AS a, CASE WHEN c_nationkey % 4 > 0 THEN c_nationkey % 2 END::INT AS b FROM customer)"


def _pairs(star: Star) -> DataFrame:
    part = lambda c, k: F.when(F.col(c) % k > 0, (F.col(c) % 2).cast("int"))
    return star.table("customer").select(F.col("c_custkey").alias("id"), part("c_custkey", 3).alias("a"), part("c_nationkey", 4).alias("b"))


@query(f"SELECT id, (a + b)::INT AS total FROM {_PAIRS}")
def complete_sum(star: Star) -> DataFrame:
    return _pairs(star).select("id", S.complete_sum(F.col("a"), F.col("b")).alias("total"))


@query(f"SELECT id, CASE WHEN a IS NULL AND b IS NULL THEN NULL WHEN coalesce(a = 1, false) OR coalesce(b = 1, false) THEN 1 ELSE 0 END::INT AS any_one FROM {_PAIRS}")
def three_valued_or(star: Star) -> DataFrame:
    return _pairs(star).select("id", S.any_one(F.col("a"), F.col("b")).alias("any_one"))


@query("SELECT l_orderkey, l_linenumber, l_quantity / nullif(l_discount, 0) AS ratio FROM lineitem")
def safe_ratio(star: Star) -> DataFrame:
    return star.table("lineitem").select("l_orderkey", "l_linenumber", S.safe_ratio(F.col("l_quantity"), F.col("l_discount")).alias("ratio"))


@query(f"WITH {STAYS}, {NURSE} SELECT s.stay_key, coalesce(n, 0)::BIGINT AS n FROM stays s LEFT JOIN (SELECT stay_key, count(*) AS n FROM nurse GROUP BY stay_key) c ON s.stay_key = c.stay_key")
def zero_fill(star: Star) -> DataFrame:
    counts = E.in_window(star.nurse()).groupBy("stay_key").agg(F.count("*").alias("n"))
    return star.stays().join(counts, "stay_key", "left").select("stay_key", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT event_id, least(greatest(value, 0.0), 200.0) AS value FROM events")
def clip(star: Star) -> DataFrame:
    return star.table("events").select("event_id", F.least(F.greatest("value", F.lit(0.0)), F.lit(200.0)).alias("value"))


# -- joins


@query(f"WITH {STAYS}, {NURSE} SELECT n.stay_key, offset_min, hospital FROM nurse n JOIN stays s ON n.stay_key = s.stay_key")
def join_inner(star: Star) -> DataFrame:
    return E.in_window(star.nurse()).join(star.stays(), "stay_key").select("stay_key", "offset_min", "hospital")


@query("SELECT c_custkey, coalesce(n, 0)::BIGINT AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def join_left(star: Star) -> DataFrame:
    n = star.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return star.table("customer").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("""SELECT coalesce(a.k, b.k) AS k, a.n AS urgent, b.n AS returned FROM
(SELECT o_custkey AS k, count(*)::BIGINT AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) a FULL JOIN
(SELECT o_custkey AS k, count(*)::BIGINT AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) b ON a.k = b.k""")
def join_full_outer(star: Star) -> DataFrame:
    o = star.table("orders").withColumnRenamed("o_custkey", "k")
    a = o.where("o_orderpriority = '1-URGENT'").groupBy("k").agg(F.count("*").alias("urgent"))
    b = o.where("o_orderstatus = 'P'").groupBy("k").agg(F.count("*").alias("returned"))
    return a.join(b, "k", "full_outer").select("k", "urgent", "returned")


@query("""SELECT user_id, max(value) FILTER (WHERE event_type = 'click') AS click_max, avg(value) FILTER (WHERE event_type = 'view') AS view_mean,
count(*) FILTER (WHERE event_type = 'purchase')::BIGINT AS purchases FROM events GROUP BY user_id""".replace("avg(value) FILTER (WHERE event_type = 'view')", "round(avg(value) FILTER (WHERE event_type = 'view'), 6)"))
def multi_agg_outer(star: Star) -> DataFrame:
    """Aligned columns of several signals: one aggregation with conditions instead of a chain of outer joins."""
    of = lambda t: F.when(F.col("event_type") == t, F.col("value"))
    return star.table("events").groupBy("user_id").agg(F.max(of("click")).alias("click_max"), F.round(F.avg(of("view")), 6).alias("view_mean"), F.count(of("purchase")).alias("purchases"))


@query(f"WITH {STAYS} SELECT stay_key, unit_id FROM stays WHERE unit_id IN (SELECT unit_id FROM stays GROUP BY unit_id HAVING count(*) >= 10)")
def join_semi_having(star: Star) -> DataFrame:
    return E.large_groups(star.stays(), "unit_id", 10).select("stay_key", "unit_id")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def join_semi(star: Star) -> DataFrame:
    good = star.table("customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"))
    return star.table("orders").join(good, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def join_anti(star: Star) -> DataFrame:
    return star.table("customer").join(star.table("events").select(F.col("user_id").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("""WITH v AS (SELECT n_name, quantile_cont(c_acctbal, 0.5) AS med FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)
SELECT n_name, round((SELECT avg(CASE WHEN c_acctbal < v.med THEN 1.0 ELSE 0.0 END) FROM customer), 8)::DOUBLE AS percentile FROM v""")
def empirical_percentile(star: Star) -> DataFrame:
    c = star.table("customer").join(star.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    v = c.groupBy("n_name").agg(F.percentile("c_acctbal", F.lit(0.5)).alias("value")).withColumn("metric", F.lit("balance"))
    dist = star.table("customer").select(F.lit("balance").alias("metric"), F.col("c_acctbal").alias("value"))
    return A.empirical_percentiles(v, dist, ("metric",), "value").select("n_name", F.round("percentile", 8).alias("percentile"))


@query(f"WITH {NURSE}, {MONITOR} SELECT a.stay_key, a.n AS nurse_n, b.n AS monitor_n FROM (SELECT stay_key, count(*)::BIGINT AS n FROM nurse GROUP BY 1) a JOIN (SELECT stay_key, count(*)::BIGINT AS n FROM monitor GROUP BY 1) b ON a.stay_key = b.stay_key")
def join_streams(star: Star) -> DataFrame:
    n = lambda df, name: E.in_window(df).groupBy("stay_key").agg(F.count("*").alias(name))
    return n(star.nurse(), "nurse_n").join(n(star.monitor(), "monitor_n"), "stay_key")


@query("SELECT event_id, o_orderkey FROM events JOIN orders ON user_id = o_custkey WHERE value BETWEEN o_totalprice / 100000 AND o_totalprice / 1000")
def join_fanout(star: Star) -> DataFrame:
    o = star.table("orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey", "o_totalprice")
    return star.table("events").join(o, "user_id").where("value between o_totalprice / 100000 and o_totalprice / 1000").select("event_id", "o_orderkey")


# -- aggregates


@query("SELECT user_id, count(*)::BIGINT AS n FROM events GROUP BY user_id")
def agg_count(star: Star) -> DataFrame:
    return star.table("events").groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, count(*)::BIGINT AS n, count(CASE WHEN c_acctbal >= 0 THEN c_acctbal END)::BIGINT AS nonnull FROM customer GROUP BY 1")
def agg_count_nonnull(star: Star) -> DataFrame:
    return star.table("customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count(S.sentinel_null(F.col("c_acctbal"))).alias("nonnull"))


@query("SELECT event_type, count(DISTINCT user_id)::BIGINT AS stays FROM events GROUP BY 1")
def agg_count_distinct(star: Star) -> DataFrame:
    return star.table("events").groupBy("event_type").agg(F.countDistinct("user_id").alias("stays"))


@query("SELECT user_id, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1")
def agg_minmax(star: Star) -> DataFrame:
    return star.table("events").groupBy("user_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def agg_sum(star: Star) -> DataFrame:
    return star.table("orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 8)::DOUBLE AS share FROM orders GROUP BY 1")
def agg_mean(star: Star) -> DataFrame:
    return star.table("orders").groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 8).alias("share"))


@query("SELECT user_id, round(quantile_cont(value, 0.5), 8) AS median FROM events GROUP BY 1")
def agg_median(star: Star) -> DataFrame:
    return A.quantile(star.table("events"), "value", [0.5], ("user_id",)).select("user_id", F.round("cut", 8).alias("median"))


@query("SELECT event_type, round(quantile_cont(value, 0.1), 8) AS p10, round(quantile_cont(value, 0.9), 8) AS p90 FROM events GROUP BY 1")
def agg_quantile(star: Star) -> DataFrame:
    cuts = A.quantile(star.table("events"), "value", [0.1, 0.9], ("event_type",))
    at = lambda p: F.round(F.max(F.when(F.col("share") == p, F.col("cut"))), 8)
    return cuts.groupBy("event_type").agg(at(0.1).alias("p10"), at(0.9).alias("p90"))


@query("SELECT user_id, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 8) AS iqr FROM events GROUP BY 1")
def agg_iqr(star: Star) -> DataFrame:
    cuts = A.quantile(star.table("events"), "value", [0.25, 0.75], ("user_id",))
    return cuts.groupBy("user_id").agg(F.round(F.max("cut") - F.min("cut"), 8).alias("iqr"))


@query(f"WITH {NURSE}, {metrics('nurse', 'nm')} SELECT stay_key, n_gaps_gt30m, n_gaps_gt2h, n_gaps_gt4h FROM nm")
def agg_cond_count(star: Star) -> DataFrame:
    return E.stay_metrics(E.in_window(star.nurse())).select("stay_key", "n_gaps_gt30m", "n_gaps_gt2h", "n_gaps_gt4h")


@query(f"WITH {NURSE}, {metrics('nurse', 'nm')} SELECT stay_key, frac_time_in_gaps FROM nm")
def agg_cond_sum(star: Star) -> DataFrame:
    return E.stay_metrics(E.in_window(star.nurse())).select("stay_key", "frac_time_in_gaps")


@query(f"WITH {STAYS}, {NURSE}, {metrics('nurse', 'nm')} SELECT hospital, round(avg(CASE WHEN n_records < 3 THEN 1.0 ELSE 0.0 END), 8)::DOUBLE AS share_under, quantile_cont(CASE WHEN n_records >= 3 THEN n_records END, 0.5)::DOUBLE AS median_n FROM nm JOIN stays USING (stay_key) GROUP BY hospital")
def agg_cond_share(star: Star) -> DataFrame:
    m = E.stay_metrics(E.in_window(star.nurse())).join(star.stays(), "stay_key")
    under = (F.col("n_records") < 3).cast("double")
    return m.groupBy("hospital").agg(F.round(F.avg(under), 8).alias("share_under"), F.percentile(F.when(F.col("n_records") >= 3, F.col("n_records")), F.lit(0.5)).alias("median_n"))


@query("SELECT o_orderpriority, count(*)::BIGINT AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def value_counts(star: Star) -> DataFrame:
    return star.table("orders").na.drop(subset=["o_orderpriority"]).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT event_type, round(stddev_samp(value), 6) AS sd FROM events GROUP BY 1")
def agg_std(star: Star) -> DataFrame:
    return star.table("events").groupBy("event_type").agg(F.round(F.stddev_samp("value"), 6).alias("sd"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def corr_pearson(star: Star) -> DataFrame:
    return star.table("lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@query(f"WITH {NURSE}, {MONITOR}, p AS (SELECT a.n AS x, b.n AS y FROM (SELECT stay_key, count(*) AS n FROM nurse GROUP BY 1) a JOIN (SELECT stay_key, count(*) AS n FROM monitor GROUP BY 1) b ON a.stay_key = b.stay_key) SELECT round(corr(rx, ry), 6) AS spearman FROM (SELECT {_RANK.format('x')} AS rx, {_RANK.format('y')} AS ry FROM p)")
def corr_spearman(star: Star) -> DataFrame:
    return A.spearman(join_streams(star), "nurse_n", "monitor_n").select(F.round("spearman", 6).alias("spearman"))


@query("SELECT event_type, list_sort(list(DISTINCT hour(ts)::INT)) AS hours FROM events WHERE value > 400 GROUP BY 1")
def agg_sorted_list(star: Star) -> DataFrame:
    return star.table("events").where("value > 400").groupBy("event_type").agg(F.array_sort(F.collect_set(F.hour("ts"))).alias("hours"))


@query("""SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS f, count(*) FILTER (WHERE o_orderstatus = 'O')::BIGINT AS o,
count(*) FILTER (WHERE o_orderstatus = 'P')::BIGINT AS p FROM orders GROUP BY 1""")
def pivot_counts(star: Star) -> DataFrame:
    p = star.table("orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return p.select("o_custkey", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("SELECT o_custkey, min(total) AS least FROM (SELECT o_custkey, o_orderdate::DATE AS d, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY 1, 2) WHERE n = 2 GROUP BY 1")
def two_stage_agg(star: Star) -> DataFrame:
    days = star.table("orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("d")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"))
    return days.where("n = 2").groupBy("o_custkey").agg(F.min("total").alias("least"))


@query(f"SELECT event_type, max_by(bin, struct_pack(share := share, lo := -lo)) AS peak FROM (SELECT event_type, {_BIN.format('ts')} AS bin, min(hour(ts)) // 2 AS lo, round(avg(CASE WHEN value < 50 THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS share FROM events GROUP BY 1, 2) GROUP BY 1")
def argmax_bin(star: Star) -> DataFrame:
    low = (F.col("value") < 50).cast("double")
    lo = F.floor(F.hour("ts") / 2)
    bins = star.table("events").groupBy("event_type", S.bin_2h(F.hour("ts")).alias("bin")).agg(F.round(F.avg(low), 9).alias("share"), F.min(lo).alias("lo"))
    return bins.groupBy("event_type").agg(F.max_by("bin", F.struct("share", -F.col("lo"))).alias("peak"))


@query("SELECT user_id, count(*)::BIGINT AS n FROM events GROUP BY 1 HAVING count(*) >= 60 AND sum(CASE WHEN value < 50 THEN 1 ELSE 0 END) >= 40 AND count(DISTINCT hour(ts)) >= 20")
def having_multi(star: Star) -> DataFrame:
    g = star.table("events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum((F.col("value") < 50).cast("long")).alias("low"), F.countDistinct(F.hour("ts")).alias("hours"))
    return g.where("n >= 60 and low >= 40 and hours >= 20").select("user_id", "n")


@query("SELECT c_mktsegment, string_agg(DISTINCT n_name, '|' ORDER BY n_name) AS nations FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def string_agg(star: Star) -> DataFrame:
    c = star.table("customer").join(star.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("c_mktsegment").agg(F.array_join(F.array_sort(F.collect_set("n_name")), "|").alias("nations"))


@query("SELECT round(count(CASE WHEN c_acctbal >= 0 THEN c_acctbal END) / count(*)::DOUBLE, 8) AS share FROM customer")
def coverage_share(star: Star) -> DataFrame:
    return star.table("customer").agg(F.round(F.count(S.sentinel_null(F.col("c_acctbal"))) / F.count("*"), 8).alias("share"))


# -- windows, sorts and sets


@query(f"WITH {NURSE} SELECT stay_key, offset_min, offset_min - lag(offset_min) OVER (PARTITION BY stay_key ORDER BY offset_min) AS gap FROM nurse")
def gap_lag(star: Star) -> DataFrame:
    w = Window.partitionBy("stay_key").orderBy("offset_min")
    return E.in_window(star.nurse()).withColumn("gap", F.col("offset_min") - F.lag("offset_min").over(w))


@query("SELECT event_type, h, n, round(n / (sum(n) OVER (PARTITION BY event_type))::DOUBLE, 8) AS share FROM (SELECT event_type, hour(ts)::INT AS h, count(*)::BIGINT AS n FROM events GROUP BY 1, 2)")
def share_of_group(star: Star) -> DataFrame:
    n = star.table("events").groupBy("event_type", F.hour("ts").alias("h")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("event_type")), 8))


@query("SELECT event_id, value <= cut AS low FROM events JOIN (SELECT event_type, quantile_cont(value, 0.1) AS cut FROM events GROUP BY 1) USING (event_type)")
def local_quantile_flag(star: Star) -> DataFrame:
    e = star.table("events")
    return e.join(A.quantile(e, "value", [0.1], ("event_type",)), "event_type").select("event_id", (F.col("value") <= F.col("cut")).alias("low"))


@query("SELECT event_id, value <= (SELECT quantile_cont(value, 0.1) FROM events) AS low FROM events")
def global_quantile_flag(star: Star) -> DataFrame:
    e = star.table("events")
    return e.crossJoin(F.broadcast(A.quantile(e, "value", [0.1]))).select("event_id", (F.col("value") <= F.col("cut")).alias("low"))


@query("SELECT event_type, h, n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, h) AS rn FROM (SELECT event_type, hour(ts)::INT AS h, count(*)::BIGINT AS n FROM events GROUP BY 1, 2)) WHERE rn <= 3")
def topk_per_group(star: Star) -> DataFrame:
    n = star.table("events").groupBy("event_type", F.hour("ts").alias("h")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type").orderBy(F.desc("n"), "h")
    return n.withColumn("rn", F.row_number().over(w)).where("rn <= 3").drop("rn")


@query("SELECT n_name, n, round(sum(n) OVER (ORDER BY n DESC, n_name ROWS UNBOUNDED PRECEDING) / (sum(n) OVER ())::DOUBLE, 8) AS cumulative FROM (SELECT n_name, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)")
def cumulative_share(star: Star) -> DataFrame:
    n = star.table("customer").join(star.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))
    placed = sums_before(n, [], [F.desc("n"), F.col("n_name")], {"before": F.col("n")})
    total = F.broadcast(n.agg(F.sum("n").alias("total")))  # one row
    return placed.crossJoin(total).select("n_name", "n", F.round((F.col("before") + F.col("n")) / F.col("total"), 8).alias("cumulative"))


@query("SELECT n_name, n, row_number() OVER (ORDER BY n DESC, n_name)::INT AS place FROM (SELECT n_name, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) ORDER BY n DESC, n_name")
def sort_multi(star: Star) -> DataFrame:
    n = star.table("customer").join(star.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))
    return numbered(n, [F.desc("n"), F.col("n_name")], "place").withColumn("place", (F.col("place") + 1).cast("int")).orderBy(F.desc("n"), F.asc("n_name"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk_global(star: Star) -> DataFrame:
    return star.table("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT c_nationkey::INT AS nationkey, 'customer' AS kind, c_acctbal AS bal FROM customer UNION ALL SELECT s_nationkey::INT, 'supplier', s_acctbal FROM supplier")
def union_all(star: Star) -> DataFrame:
    c = star.table("customer").select(F.col("c_nationkey").alias("nationkey"), F.lit("customer").alias("kind"), F.col("c_acctbal").alias("bal"))
    s = star.table("supplier").select(F.col("s_nationkey").alias("nationkey"), F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("bal"))
    return c.unionByName(s)


@query("SELECT DISTINCT o_custkey FROM orders")
def distinct_keys(star: Star) -> DataFrame:
    return star.table("orders").select("o_custkey").dropDuplicates()


@query("SELECT p_type, count(*)::BIGINT AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type")
def sort_single(star: Star) -> DataFrame:
    return star.table("part").groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place = 1")
def best_row(star: Star) -> DataFrame:
    """The best row of each key without a sort: the largest struct of price and, for ties, of the smaller key."""
    best = star.table("orders").groupBy("o_custkey").agg(F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("b"))
    return best.select("o_custkey", (-F.col("b.k")).alias("o_orderkey"), F.col("b.o_totalprice").alias("o_totalprice"))


@query("SELECT s_suppkey, n FROM supplier LEFT JOIN (SELECT c_nationkey, count(*)::BIGINT AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) ON c_nationkey = s_nationkey")
def lookup_map(star: Star) -> DataFrame:
    """A value looked up by key; null where the index has none."""
    rich = star.table("customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.count("*").alias("n"))
    return star.table("supplier").join(rich, "s_nationkey", "left").select("s_suppkey", "n")
