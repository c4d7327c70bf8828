"""The trie of conversation prefixes.

A turn is known by a digest of its role and text. A conversation's first d turns have the fingerprint
t1 * B + t2 * B^2 + ... + td * B^d modulo a prime, summed by numpy in one scan of turns sorted by conversation and
depth; conversations that agree in depth and fingerprint are candidates for one node. A group is verified turn by turn:
each member's turn at that depth, and the group of its first d - 1 turns, must be those of the group's representative,
its smallest conversation. Members that differ get a fingerprint of their own from there on, and groups are
verified again, until none is mixed.

Sums along conversations go over ranges of sorted rows: each task sums its own range, and what a conversation brings from
earlier ranges is one number per task. So a conversation may have any share of all turns.

Rollups need no walk over levels. A node belongs to its smallest conversation; the nodes of a conversation are then the last
stretch of its path, and the subtree of v holds the nodes of all members of v, less those of the owner of v above v.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.work import materialize, spread_join

U = np.uint64
PRIME = (1 << 61) - 1
#: The base B. Any large number does.
BASE = 0x0B5E_7C4A_91D3_26F5
#: Conversation ids whose digits are written into one row before a node's are strung together.
LISTED = 4096

WORD = r"[^\x20\x09-\x0D]+"
_P, _LOW31, _LOW30, _LOW32 = U(PRIME), U((1 << 31) - 1), U((1 << 30) - 1), U((1 << 32) - 1)


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for any 64-bit x."""
    x = (x & _P) + (x >> U(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, for a and b below it."""
    a1, a0, b1, b0 = a >> U(31), a & _LOW31, b >> U(31), b & _LOW31
    middle = a1 * b0 + a0 * b1
    return reduced(reduced((a1 * b1 << U(1)) + (middle >> U(30)) + ((middle & _LOW30) << U(31))) + reduced(a0 * b0))


def powers(exponent: np.ndarray) -> np.ndarray:
    """BASE to the exponents, modulo PRIME."""
    out, square, left = np.ones(len(exponent), U), np.full(1, BASE % PRIME, U), exponent.astype(U)
    while left.any():
        out = np.where(left & U(1), times(out, square), out)
        square, left = times(square, square), left >> U(1)
    return out


def running_sums(terms: np.ndarray) -> np.ndarray:
    """Running sums modulo PRIME of terms below it, at most 2^32 of them."""
    low, high = np.cumsum(terms & _LOW32), np.cumsum(terms >> U(32))
    return reduced(times(reduced(high), np.full(1, 1 << 32, U)) + reduced(low))


def turn_terms(batch: pa.RecordBatch) -> np.ndarray:
    """The term of each turn in its conversation's fingerprints."""
    digests = batch.column("digest").to_pylist()
    turn = np.frombuffer(b"".join(d[:8] for d in digests), np.dtype("<u8")).astype(U)
    return times(reduced(turn), powers(batch.column("depth").to_numpy()))


def _column_terms(name: str) -> Callable[[pa.RecordBatch], np.ndarray]:
    return lambda batch: reduced(batch.column(name).to_numpy().astype(np.int64).view(U))


def _scanner(terms: Callable[[pa.RecordBatch], np.ndarray], modulus: int):
    """Adds the sum of a conversation's terms up to each row, and before it, within the task's rows; and the task's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, so_far = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            term = terms(batch) % U(modulus)
            sums = np.concatenate([np.zeros(1, U), running_sums(term)])
            edge = np.r_[True, conv[1:] != conv[:-1]]
            first = np.maximum.accumulate(np.where(edge, np.arange(len(conv)), 0))
            bring = np.zeros(len(conv), U)
            if last is not None and conv[0] == last:
                bring[: int(np.argmax(edge[1:])) + 1 if edge[1:].any() else len(conv)] = U(so_far)
            upto, before = (reduced(reduced(sums[i] + _P - sums[first]) + bring) % U(modulus) for i in (np.arange(len(conv)) + 1, np.arange(len(conv))))
            last, so_far = conv[-1], int(upto[-1])
            columns = [*batch.columns, pa.array(upto.astype(np.int64)), pa.array(before.astype(np.int64)), pa.array(np.full(len(conv), part, np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "upto", "before", "part"])

    return run


def along(rows: DataFrame, terms: Callable[[pa.RecordBatch], np.ndarray], modulus: int, label: str) -> DataFrame:
    """rows with upto and before: sums modulo `modulus` of the terms of each conversation's rows, in order of depth.

    Rows of one conversation may lie in many ranges. The driver sees one row for each range.
    """
    spark = rows.sparkSession
    ordered = rows.repartitionByRange("conv_id", "depth").sortWithinPartitions("conv_id", "depth")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    local = materialize(ordered.mapInArrow(_scanner(terms, modulus), f"{kinds}, upto bigint, before bigint, part int"), label)
    ends = local.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "depth", "upto")).alias("last"))
    brought, last, so_far = [], None, 0
    for r in sorted(ends.collect(), key=lambda r: r["part"]):
        carry = so_far if last == r["first"] else 0
        if carry:
            brought.append((r["part"], r["first"], carry))
        last, so_far = r["last"]["conv_id"], (r["last"]["upto"] + (carry if r["last"]["conv_id"] == r["first"] else 0)) % modulus
    if not brought:
        return local.drop("part")
    carries = F.broadcast(spark.createDataFrame(brought, "part int, conv_id bigint, carry bigint"))
    whole = lambda c: ((F.col(c) + F.coalesce("carry", F.lit(0))) % modulus).alias(c)
    return local.join(carries, ["part", "conv_id"], "left").select(*rows.columns, whole("upto"), whole("before"))


def numbered_turns(table: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, nth, digest, n_words) of each turn: nth counts from 0, by turn (null first), then digest of role and text.

    A null role or text is empty. Rows without a conversation's id are left out. A digest has the first 16 bytes of SHA-256.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    rows = table.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    ordered = rows.where("conv_id is not null").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(ordered.select("conv_id", "digest", "n_words", F.monotonically_increasing_id().alias("place")), "turns")
    part = F.shiftright("place", 33).cast("int")
    sizes, before, offsets = sorted((r[0], r[1]) for r in placed.groupBy(part).count().collect()), 0, []
    for p, n in sizes:  # one row for each range
        offsets.append((p, before))
        before += n
    known = F.broadcast(table.sparkSession.createDataFrame(offsets, "part int, earlier bigint"))
    at = F.col("earlier") + F.col("place").bitwiseAND((1 << 33) - 1)
    counted = placed.withColumn("part", part).join(known, "part").select("conv_id", "digest", "n_words", at.alias("at"))
    starts = counted.groupBy("conv_id").agg(F.min("at").alias("start"))
    return spread_join(counted, starts, "conv_id", "at", counted=placed).select("conv_id", (F.col("at") - F.col("start")).alias("nth"), "digest", "n_words")


_KEY = ["depth", "fp", "split"]
_TURN = ["digest", "fp_before", "split_before"]


def _groups(rows: DataFrame) -> DataFrame:
    """A row for each candidate group; mixed if its members' turns, or their groups one turn earlier, differ from its representative's."""
    turn = F.struct(*_TURN)
    found = rows.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("n_words").alias("n_words"), F.min(turn).alias("low"), F.max(turn).alias("high"), F.min_by(turn, "conv_id").alias("own"))
    return found.select(*_KEY, "conv_id", "n_convs", "n_words", "own.fp_before", "own.split_before", "own", (F.col("low") != F.col("high")).alias("mixed"))


def verified(turns: DataFrame, modulus: int = PRIME) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): turns with a key (depth, fp, split), which is equal exactly for equal prefixes, and a row for each key.

    fp_before and split_before are those of the prefix one turn shorter. Members that differ from their representative
    get a label, and the labels of a conversation so far are added to its split.
    """
    zero = F.lit(0).cast("long")
    scanned = along(turns.select("conv_id", F.col("depth").cast("long"), "digest", "n_words"), turn_terms, modulus, "prefixes")
    rows = scanned.withColumnsRenamed({"upto": "fp", "before": "fp_before"}).withColumns({"split": zero, "split_before": zero})
    groups, again = materialize(_groups(rows), "groups"), 0
    while not (mixed := groups.where("mixed")).isEmpty():
        again += 1
        label = F.when(F.struct(*_TURN) != F.col("own"), F.pmod(F.xxhash64(*_TURN, F.lit(again)), F.lit(PRIME)))
        keyed = materialize(rows.withColumn("key", F.struct(*_KEY)), "keyed")
        told = spread_join(keyed, mixed.select(F.struct(*_KEY).alias("key"), "own"), "key", "conv_id").select("conv_id", "depth", label.alias("label")).where("label is not null")
        labelled = rows.join(told, ["conv_id", "depth"], "left").withColumn("label", F.coalesce("label", zero))
        summed = along(labelled, _column_terms("label"), PRIME, "labels")
        rows = summed.select("conv_id", "depth", "digest", "n_words", "fp", "fp_before", ((F.col("split") + F.col("upto")) % PRIME).alias("split"), ((F.col("split_before") + F.col("before")) % PRIME).alias("split_before"))
        groups = materialize(_groups(rows), "groups")
    return rows, groups


def _ends_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's listed ids, read in order; a node's rows follow each other."""
    last, digest = None, None

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(dict(zip((*_KEY, "ends_sha256"), ([x] for x in (*last, digest.hexdigest())))), schema=_ENDS)

    for batch in batches:
        for *key, listed in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "listed"))):
            if key != last:
                if last is not None:
                    yield told()
                last, digest = key, sha256()
            else:
                digest.update(b",")
            digest.update(listed.encode())
    if last is not None:
        yield told()


_ENDS = pa.schema([("depth", pa.int64()), ("fp", pa.int64()), ("split", pa.int64()), ("ends_sha256", pa.string())])


def ends_digests(ends: DataFrame) -> DataFrame:
    """The key of each node with ends_sha256, of (conv_id, key): ids are strung together LISTED at a time, then read in order."""
    listed = ends.groupBy(*_KEY, F.floor(F.col("conv_id") / LISTED).alias("run")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("listed"))
    ordered = listed.repartition(*_KEY).sortWithinPartitions(*_KEY, "run").select(*_KEY, "listed")
    return ordered.mapInArrow(_ends_digest, "depth bigint, fp bigint, split bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, members: DataFrame, *, modulus: int = PRIME) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of turns (conv_id, depth from 1 without gaps, digest, n_words) and members (conv_id, once each).

    nodes: key (depth, fp, split), conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves (childless nodes
    in the subtree) and saved_tokens (over the subtree, n_convs - 1 times the words of a node's last turn). The root has
    depth 0 and all members, also those without turns. ends: conv_id and the key of its last node. Without members
    there is no node.

    The representative of a prefix is its smallest conversation. modulus is that of fingerprints; a small one only costs
    rounds of verification.
    """
    spark = turns.sparkSession
    rows, groups = verified(turns, modulus)
    smallest = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = smallest.select(zero.alias("depth"), zero.alias("fp"), zero.alias("split"), "conv_id", "n_convs", zero.alias("n_words"), F.lit(None).cast("long").alias("fp_before"), F.lit(None).cast("long").alias("split_before"))
    nodes = groups.select(*root.columns)
    first = smallest.first()
    if first is None:
        return root.select(*_KEY, "conv_id", *(F.lit(None).cast("long").alias(c) for c in ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"))), members.select("conv_id", *(zero.alias(c) for c in _KEY))
    above = F.struct((F.col("depth") - 1).alias("depth"), F.col("fp_before").alias("fp"), F.col("split_before").alias("split"))
    children = nodes.groupBy(above.alias("k")).agg(F.count("*").alias("n_children")).select("k.*", "n_children")
    nodes = materialize(nodes.unionByName(root).join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", zero)), "nodes")

    # the parent's conversation; children of one node may be very many
    low = materialize(nodes.where("depth > 1").select(*_KEY, above.alias("above")), "children")
    owner = nodes.where("depth > 0").select(F.struct(*_KEY).alias("above"), F.col("conv_id").alias("parent_conv_id"))
    parents = spread_join(low, owner, "above", "fp").select(*_KEY, "parent_conv_id")
    parents = parents.unionByName(nodes.where("depth = 1").select(*_KEY, F.lit(first["conv_id"]).alias("parent_conv_id")))

    # what each conversation owns, and what it brings to every node it is a member of
    own = nodes.select("conv_id", "depth", "fp", "split", ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    owned = materialize(own.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves")), "owned")
    slim = rows.select("conv_id", *_KEY)
    brought = spread_join(slim, owned, "conv_id", "depth").groupBy(*_KEY).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("n_leaves"))
    whole = owned.agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("n_leaves")).select(*(zero.alias(c) for c in _KEY), "saved", "n_leaves")
    above_own = along(own.where("depth > 0").select("conv_id", "depth", "fp", "split", "saved"), _column_terms("saved"), PRIME, "owned-sums")
    joined = nodes.select(*_KEY, "conv_id", "n_convs", "n_children")
    for facts in (parents, brought.unionByName(whole), above_own.select(*_KEY, F.col("before").alias("above"))):
        joined = joined.join(facts, _KEY, "left")
    told = joined.withColumn("saved_tokens", F.col("saved") - F.coalesce("above", zero))
    last = rows.groupBy("conv_id").agg(F.max(F.struct(*_KEY)).alias("k")).select("conv_id", "k.*")
    ends = members.join(last, "conv_id", "left").select("conv_id", *(F.coalesce(c, zero).alias(c) for c in _KEY))
    return told.select(*_KEY, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), ends
