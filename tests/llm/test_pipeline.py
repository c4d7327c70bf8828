"""Queries without SQL and the pipeline's stages against brute force on a small table."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import groups, lines_by_hand, repeats_by_hand

from recordloom.llm import packing, queries
from recordloom.llm.work import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_op4_equals_brute_force(spark, documents):
    rows = documents.orderBy("doc_id").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op4_suffix_dedup(spark, SF).collect()}
    assert got == dict(zip([r.doc_id for r in rows], repeats_by_hand([r.text for r in rows])))


def test_op5_agrees_with_the_labels(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/../sf0.01/labels.parquet").collect()}
    got = {r.doc_id: r.toxic for r in queries.op5_toxicity(spark, f"{SF}/../sf0.01").collect()}
    clean = [d for d, t in labels.items() if not t]
    assert sum(got[d] for d in clean) <= 0.02 * len(clean)
    assert sum(got[d] for d, t in labels.items() if t) >= 0.8 * sum(labels.values())


def test_op9_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in queries.op9_neighbours(spark, SF).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        hit.append(len(got[ids[q]] & set(ids[np.argsort(-s)[:20]])) / 20)
    assert len(got) == len(hit) and np.mean(hit) >= 0.9


def test_op10_keeps_every_id(spark, documents):
    encoder = packing.Encoder(packing.default_tokenizer())
    want = {r.doc_id: len(encoder.encode(r.text)) // 4 + 1 for r in documents.collect()}
    got = Counter()
    for r in queries.op10_packing(spark, SF).collect():
        got[r.doc_id] += r.length
    assert got == want


def test_stages(spark, documents):
    """Each stage on what the one before kept."""
    kept, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = (kept, out := materialize(stage(spark, kept, SF), "test-stage"))
        kept = out
    text = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    for name, (before, after) in list(seen.items())[:-1]:
        assert after.columns == documents.columns, name
    before, after = seen["toxicity"]
    assert set(text(after)) <= set(text(before))
    before, after = seen["line dedup"]
    assert text(after) == sorted((d, t) for d, _, _, t in lines_by_hand([(r.doc_id, r.text) for r in before.collect()]))
    before, after = seen["near-dedup"]
    parts = groups(text(before), 5)
    assert sorted(d for d, _ in text(after)) == sorted(set(parts.values()))
    before, after = seen["mixing"]
    assert set(text(after)) <= set(text(before)) and max(Counter(d for d, _ in text(after)).values()) <= 3
    before, after = seen["packing"]
    encoder = packing.Encoder(packing.default_tokenizer())
    assert after.agg(F.sum("length")).first()[0] == sum(len(encoder.encode(t)) // 4 + 1 for _, t in text(before))
    assert corpus_pipeline.run(spark, SF).count() == after.count()


TWIN = " ".join(f"n{i}" for i in range(60))
LONG = " ".join(f"m{i}" for i in range(150_000))
ODD = [
    (None, None, None, None, None),
    (None, "lines without an id", "en", None, 19),
    (None, "lines without an id", "en", None, 19),
    (900_001, None, "en", "odd", None),
    (900_002, "", None, "odd", 0),
    (900_003, LONG, "en", None, len(LONG)),
    (900_004, TWIN, "en", "odd", len(TWIN)),
    (900_004, TWIN, "en", "odd", len(TWIN)),
    (900_005, TWIN, "en", None, len(TWIN)),
]


@pytest.fixture(scope="module")
def odd(spark, documents):
    """Documents with nulls, empty, very long and repeated ones, and columns named like those that operators use."""
    rows = documents.unionByName(spark.createDataFrame(ODD, documents.schema.simpleString()[7:-1].replace(":", " ")))
    names = ["id", "key", "row", "own", "size", "copies", "carried", "component_id", "kept", "n_lines", "tokens", "severity", "toxic", "spans"]
    return materialize(rows.withColumns({n: F.lit(n) for n in names}), "test-odd")


def texts_of(df, odd_only=True):
    found = Counter((r.doc_id, r.text) for r in df.collect())
    return Counter({k: n for k, n in found.items() if not odd_only or k[0] is None or k[0] > 900_000})


def test_toxicity_stage_keeps_odd_rows(spark, documents, odd):
    out = corpus_pipeline.toxic_out(spark, odd, SF)
    assert out.columns == documents.columns and texts_of(out) == Counter((r[0], r[1]) for r in ODD)


def test_line_stage_on_odd_rows(spark, documents, odd):
    out = corpus_pipeline.lines_once(spark, odd, SF)
    assert out.columns == documents.columns
    want = Counter((d, "" if d == 900_005 else t or "") for d, t, *_ in ODD)
    assert texts_of(out) == want


def test_near_dedup_stage_on_odd_rows(spark, documents, odd):
    out = corpus_pipeline.near_copies_out(spark, odd, SF)
    assert out.columns == documents.columns and texts_of(out) == Counter((r[0], r[1]) for r in ODD if r[0] != 900_005)


def test_mixing_stage_on_odd_rows(spark, documents, odd):
    out = materialize(corpus_pipeline.mixed(spark, odd, SF), "test-mixed")
    assert out.columns == documents.columns
    before, after = texts_of(odd, odd_only=False), texts_of(out, odd_only=False)
    wrong = [(d, t and t[:40], n, before[d, t]) for (d, t), n in after.items() if not (t and t.split() and n <= 3 * before[d, t])]
    assert not wrong
    assert {r.source for r in out.collect()} >= {None, "odd"}


def test_packing_stage_on_odd_rows(spark, odd):
    encoder = packing.Encoder(packing.default_tokenizer())
    want, got = Counter(), Counter()
    for r in odd.collect():
        want[r.doc_id] += len(encoder.encode(r.text or "")) // 4 + 1
    for r in corpus_pipeline.packed(spark, odd, SF).collect():
        got[r.doc_id] += r.length
    assert got == want


def test_stages_of_an_empty_table(spark, documents):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, documents.limit(0), SF)
        assert out.count() == 0 and (out.columns == documents.columns or name == "packing"), name
