"""Periodic runs against a search of all periods."""

import random

import numpy as np
import pyarrow as pa
import pytest

from recordloom.llm import queries, runs, words

DOCS = "doc_id long, text string, runs string, n_words string, collapsed string"


def by_hand(w, least):
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            start = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i > start and i + p - start >= max(least, 2 * p):
                found.setdefault((start, i + p - start), p)
            i = max(i, start + 1)
    return sorted((s, n, p) for (s, n), p in found.items())


def collapsed_by_hand(w, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize(("least", "chunk"), [(2, 1 << 20), (3, 10), (6, 100), (12, 1 << 20)])
def test_runs_equal_brute_force(least, chunk):
    rng = random.Random(least)
    for _ in range(60):
        texts = [" ".join(rng.choice("abcd"[: rng.randrange(1, 5)]) for _ in range(rng.randrange(70))) for _ in range(rng.randrange(1, 6))]
        for first, data, bounds in words.chunks(pa.array(texts), chunk):
            counts, found, collapsed = runs._search(data, bounds, least)
            for k in range(len(counts)):
                w = texts[first + k].split()
                want = by_hand(w, least)
                assert [tuple(r.values()) for r in found[k].as_py()] == want
                assert collapsed[k].as_py() == collapsed_by_hand(w, want)


def test_fibonacci_word_has_all_its_runs():
    a, b = "x", "x y"
    while len(b.split()) < 400:
        a, b = b, b + " " + a
    (_, data, bounds), = words.chunks(pa.array([b]))
    found = runs._search(data, bounds, 2)[1][0].as_py()
    assert [tuple(r.values()) for r in found] == by_hand(b.split(), 2)


def test_next_smaller_of_any_shape():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 64, 65):
        for rank in (np.arange(n), np.arange(n)[::-1].copy(), rng.permutation(n)):
            want = [next((j for j in range(i + 1, n) if rank[j] < rank[i]), n) for i in range(n)]
            assert runs.next_smaller(rank).tolist() == want


def test_odd_rows(spark):
    again = "a b c " * 5
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, again), (4, again), (4, again), (5, "é " * 12), (6, "one two")]
    table = spark.createDataFrame([(*r, "r", "n", "c") for r in rows], DOCS)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(table).collect()), key=str)
    abc = (15, [(0, 15, 3)], "a b c")
    want = [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (None, *abc), (4, *abc), (4, *abc), (5, 12, [(0, 12, 1)], "é"), (6, 2, [], "one two")]
    assert got == sorted(want, key=str)
    assert runs.periodic_runs(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(table, min_length=1)


def test_long_texts(spark):
    rng = random.Random(3)
    mixed = [rng.choice("ab") for _ in range(3000)]
    rows = [(1, "w " * 400_000), (2, "x" * 2_000_000), (3, " \n" * 1_000_000), (4, " ".join(["w"] * 100_000 + mixed))]
    got = {r.doc_id: r for r in runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 400_000, 1)] and got[1].collapsed == "w"
    assert (got[2].n_words, got[2].runs, got[3].n_words) == (1, [], 0)
    assert [tuple(x) for x in got[4].runs] == [(0, 100_000, 1)] + [(s + 100_000, n, p) for s, n, p in by_hand(mixed, 12)]


def test_query_plants_by_crc(spark, tmp_path):
    from binascii import crc32
    from hashlib import sha256

    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["ab", "cd", "ef"]) for _ in range(rng.randrange(60)))) for i in range(80)] + [(80, None), (None, "a b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for doc, text in rows[:-1]:
        w = (text or "").split()
        h = crc32(str(doc).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = by_hand(w, 12)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = got[doc]
        assert r.n_runs == len(found)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest()
        assert r.collapsed_sha256 == sha256(collapsed_by_hand(w, found).encode()).hexdigest()
