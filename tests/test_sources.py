"""Readers, writers, streaming and the driver contract."""

import pytest
from pyspark.sql import functions as F

from recordloom.sources import sinks, tables
from recordloom.streaming import extract


def test_csv_round_trip_with_declared_schema(spark, tmp_path):
    df = spark.createDataFrame([(1, 10, 2.5), (2, None, None)], "stay_id long, itemid int, valuenum double").withColumn("charttime", F.lit("2020-01-01 00:00:00"))
    sinks.write_csv(df, f"file://{tmp_path}/x.csv")
    got = tables.scan(spark, f"file://{tmp_path}/x.csv", tables.SCHEMAS["chartevents"])
    assert got.dtypes == [("stay_id", "bigint"), ("itemid", "int"), ("charttime", "timestamp_ntz"), ("valuenum", "double")]
    assert sorted((r.stay_id, r.itemid, r.valuenum) for r in got.collect()) == [(1, 10, 2.5), (2, None, None)]


def test_locate_falls_back_without_suffix(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    assert tables.locate(spark, f"file://{tmp_path}", ["b.csv.gz", "a.csv.gz"]).endswith("a.csv")
    with pytest.raises(FileNotFoundError):
        tables.locate(spark, f"file://{tmp_path}", ["c.csv.gz"])


def test_parquet_cache_is_kept_unless_forced(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert tables.to_parquet(spark.range(3), path).count() == 3
    assert tables.to_parquet(spark.range(5), path).count() == 3
    assert tables.to_parquet(spark.range(5), path, force=True).count() == 5


def test_report(spark, tmp_path):
    sinks.write_report(spark.range(2), f"file://{tmp_path}/r", "Title")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/r").collect()] == ["Title", "", "id", "0", "1"]
    sinks.write_report(spark.range(3000), f"file://{tmp_path}/all", "All")
    assert spark.read.text(f"file://{tmp_path}/all").count() == 3003


def test_stream_equals_batch(spark, tmp_path):
    spark.createDataFrame([(1, -1), (1, 0), (2, 1439), (2, 1440), (None, 5)], "stay_key long, offset_min int").write.parquet(f"{tmp_path}/in")
    stream = extract.window_events(extract.arriving(spark, f"{tmp_path}/in", "stay_key long, offset_min int"))
    extract.to_parquet(stream, f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination(60)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, 0), (2, 1439)]


def test_hourly_volume_closes_hours(spark, tmp_path):
    spark.sql("select timestamp'2020-01-01 00:10:00' + make_interval(0,0,0,0,h) as ts, 'a' as item from (select explode(sequence(0,5)) h)").write.parquet(f"{tmp_path}/in")
    stream = extract.hourly_volume(extract.arriving(spark, f"{tmp_path}/in", "ts timestamp, item string"))
    extract.to_parquet(stream, f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination(60)
    assert all(r.n == 1 for r in spark.read.parquet(f"{tmp_path}/out").collect())


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["metric", "eta2", "n"]


def test_store_needs_no_exchange(spark):
    from recordloom.operators import events as E
    from recordloom.sources import store

    rows = [(i % 7, i * 37 % 1440) for i in range(300)]
    df = spark.createDataFrame(rows + [(None, 3)], "stay_key long, offset_min int")
    names = [store.write_events(df, 3) for _ in range(2)]
    a, b = (store.events(spark, n) for n in names)
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    metrics = E.stay_metrics(a)
    joined = a.groupBy("stay_key").count().join(b.groupBy("stay_key").count().withColumnRenamed("count", "m").hint("merge"), "stay_key")
    assert "Exchange" not in plan(metrics) and "Exchange" not in plan(joined) and "Exchange" in plan(E.stay_metrics(df))
    key = lambda r: str(r[0])
    assert sorted(map(tuple, metrics.collect()), key=key) == sorted(map(tuple, E.stay_metrics(df).collect()), key=key)
    assert {tuple(r) for r in joined.collect()} == {(k, sum(x[0] == k for x in rows), sum(x[0] == k for x in rows)) for k in range(7)}
    for n in names:
        store.drop_events(spark, n)
        assert not spark.catalog.tableExists(n)
