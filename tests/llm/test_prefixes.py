"""The prefix trie against tuples of turns."""

import random
from binascii import crc32
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import prefixes, queries, work

TABLE = "conv_id long, turn int, role string, text string, digest string, nth string, depth string, fp string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "d", "n", "e", "f") for r in rows], TABLE)


def told_by_hand(rows):
    """conv_id -> [(role, text)] in order."""
    told = defaultdict(list)
    digest = lambda role, text: sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
    for conv, turn, role, text in rows:
        if conv is not None:
            told[conv].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    return {c: [x[3:] for x in sorted(turns)] for c, turns in told.items()}


def trie_by_hand(told):
    members = defaultdict(list)
    for c, turns in told.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, out = defaultdict(list), []
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        leaves, saved = (0 if children[p] else 1), (len(members[p]) - 1) * (len(p[-1][1].split()) if p else 0)
        for c in children[p]:
            more = below(c)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(told[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), *below(p), sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows, **options):
    turns = prefixes.numbered_turns(table(spark, rows))
    members = turns.select("conv_id").distinct()
    nodes, ends = prefixes.prefix_trie(turns.withColumn("depth", F.col("nth") + 1), members, **options)
    told = nodes.join(prefixes.ends_digests(ends), ["depth", "fp", "split"], "left")
    told = told.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    return sorted(map(tuple, told.collect()), key=str)


def conversations(seed, n=60, deepest=6, told="ab"):
    rng, rows = random.Random(seed), []
    for c in range(n):
        rows += [(c - 5, t, rng.choice(["user", None]), rng.choice([*told, "one two three", None])) for t in range(rng.randrange(1, deepest))]
    rows += [(100, 2, "user", "last"), (100, None, "user", "first"), (100, 1, "user", "middle"), (100, 1, "user", "at once"), (100, 1, "user", "at once"), (None, 1, "user", "a")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("modulus", "together", "listed"), [(prefixes.PRIME, 256, 4096), (1, 2, 3), (3, 256, 1)])
def test_nodes_equal_brute_force(spark, monkeypatch, modulus, together, listed):
    monkeypatch.setattr(work, "TOGETHER", together)
    monkeypatch.setattr(prefixes, "LISTED", listed)
    rows = conversations(modulus % 7)
    assert trie(spark, rows, modulus=modulus) == trie_by_hand(told_by_hand(rows))  # a modulus of 1 makes all prefixes of one length collide


def test_a_conversation_may_span_many_ranges(spark):
    rows = [(7, t, "user", f"w {t % 3}") for t in range(3000)] + [(8, t, "user", f"w {t % 3}") for t in range(2500)] + [(c, 0, "user", "w 0") for c in range(20, 40)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = trie(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 3001
    nodes = {r[1]: r for r in got}
    assert nodes[0][:6] == (7, 0, None, 22, 1, 1) and nodes[1][:6] == (7, 1, 7, 22, 1, 1) and nodes[2501][3:6] == (1, 1, 1)
    assert nodes[1][6] == 21 * 2 + 2499 * 2 and nodes[2500][6] == 2 and nodes[3000][4:7] == (0, 1, 0)
    assert nodes[1][7] == sha256(",".join(map(str, range(20, 40))).encode()).hexdigest()


def test_empty_table_has_no_nodes(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "user", "a")]) == []
    assert trie(spark, [(3, None, None, None)]) == trie_by_hand({3: [("", "")]})


def test_long_turns(spark):
    rows = [(1, 0, "user", "w " * 500_000), (2, 0, "user", "w " * 500_000), (3, 0, "user", " " * 1_000_000)]
    assert trie(spark, rows) == trie_by_hand(told_by_hand(rows))


def test_arithmetic_modulo_the_prime():
    rng = np.random.default_rng(1)
    p = prefixes.PRIME
    a, b = (np.append(rng.integers(0, p, 500), [0, 1, p - 1]).astype(np.uint64) for _ in range(2))
    assert prefixes.times(a, b).tolist() == [x * y % p for x, y in zip(a.tolist(), b.tolist())]
    assert prefixes.powers(np.array([0, 1, 2, 61, 10**9])).tolist() == [pow(prefixes.BASE, e, p) for e in (0, 1, 2, 61, 10**9)]
    total = 0
    for got, x in zip(prefixes.running_sums(a).tolist(), a.tolist()):
        total = (total + x) % p
        assert got == total
    assert prefixes.reduced(np.array([p, 2**64 - 1], np.uint64)).tolist() == [0, (2**64 - 1) % p]


def test_query_rebuilds_conversations(spark, tmp_path):
    rng = random.Random(6)
    rows = [(c, t, "user", rng.choice("abc")) for c in [*range(0, 60), *range(85, 99)] for t in range(rng.randrange(1, 6))]
    table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    own = told_by_hand(rows)
    rebuilt = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    assert any(not t for t in rebuilt.values())
    got = queries.QUERIES["op13_prefix_trie"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == trie_by_hand(rebuilt)
