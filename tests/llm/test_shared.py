"""Filters, hashing and intermediate tables."""

import numpy as np
import pyarrow as pa
import pytest

from recordloom.llm import bloom, shingles, work


def test_filters_never_deny(spark):
    hashes = lambda batch: shingles.mixed(batch.column(0).to_numpy().view(np.uint64))
    rows = spark.range(0, 6000, 1, 5).selectExpr("id % 5000 as k")  # 0..999 come twice, in other partitions
    bits = bloom.bits_for(6000)
    keys = shingles.mixed(np.arange(20_000, dtype=np.uint64))
    once, twice = (np.frombuffer(f(rows, hashes, bits), np.uint8) for f in (bloom.once_seen, bloom.twice_seen))
    assert bloom.may_contain(once, keys[:5000]).all() and bloom.may_contain(once, keys[5000:]).mean() < 0.01
    assert bloom.may_contain(twice, keys[:1000]).all() and bloom.may_contain(twice, keys[1000:5000]).mean() < 0.02


def test_a_full_filter_says_maybe(spark):
    assert bloom.bits_for(10**9) == 1 << 28 and bloom.bits_for(0) == bloom.SEGMENT_BITS


@pytest.mark.parametrize("chunk", [1 << 20, 8])
def test_shingles_ignore_batch_and_place(monkeypatch, chunk):
    monkeypatch.setattr(shingles, "CHUNK", chunk)
    texts = pa.array(["a b c d e", None, "", "x", "A\tB  c\nd", " é é é é ", "a b c d e"])
    found = list(shingles.shingle_sets(texts, 4))
    assert [len(s) for s in found] == [2, 0, 0, 1, 1, 1, 2]
    assert set(found[4].tolist()) < set(found[0].tolist()) and found[0].tolist() == found[6].tolist()
    assert [s.tolist() for s in shingles.shingle_sets(texts.slice(3, 2), 4)] == [s.tolist() for s in found[3:5]]


def test_tables_live_in_the_shared_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(work, "shared_folder", lambda _: f"file://{tmp_path}")
    assert work.materialize(spark.range(3), "x").count() == 3
    assert [p.name[:13] for p in tmp_path.iterdir()] == ["recordloom-x-"]
    work.drop_tables(spark)
    assert not [p for p in tmp_path.iterdir() if p.is_dir()]


@pytest.mark.parametrize("together", [5, 1000])
def test_frequent_values_are_spread_without_loss(spark, monkeypatch, together):
    monkeypatch.setattr(work, "TOGETHER", together)
    monkeypatch.setattr(work, "WAYS", 7)
    rows = [(1, i) for i in range(100)] + [(2, i) for i in range(6)] + [(3, 1), (4, None), (None, 2), (1, 5), (1, 5)]
    keyed = [(1, "a"), (2, "b"), (2, "c"), (3, None), (5, "d"), (None, "e")]
    left = work.materialize(spark.createDataFrame(rows, "k long, n long"), "rows")
    got = work.spread_join(left, spark.createDataFrame(keyed, "k long, v string"), "k", "n")
    want = [(k, n, v) for k, n in rows for other, v in keyed if k is not None and k == other]
    order = lambda x: tuple(str(c) for c in x)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order) and got.columns == ["k", "n", "v"]
    assert work.spread_join(left.where("k = 9"), spark.createDataFrame(keyed, "k long, v string"), "k", "n").count() == 0
