"""Near-duplicate groups by HyperMinHash.

A text's shingle hashes are dealt to buckets; each bucket keeps its smallest value as a register: the number of
leading zeros and the MANTISSA bits after the first one. An empty bucket borrows the register of the first full
one in an order of its own, so that two texts' registers agree with the probability of their Jaccard similarity,
whatever the sizes. BANDS x ROWS registers are banded: texts that agree in all registers of a band are candidates.

Texts with equal sets are one node. A bucket's pivot is its smallest id. Round 1 compares each node with the pivot
that it shares most bands with; confirmed links give components. Round 2 compares members of buckets with pivots that are in other
components, round 3 members that still are in different components. So copies are never expanded into pairs, nor into
a pair for each band, and every pair of candidates is either linked, tested, or in one component. A pair is tested by
the Jaccard estimate from its registers, corrected for registers that agree by chance, then on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.shingles import linked, mixed, shingle_sets
from recordloom.llm.work import materialize, small_batches, spread_join

U = np.uint64
BANDS, ROWS = 40, 6
REGISTERS = BANDS * ROWS
MANTISSA, VALUE_BITS = 10, 48
#: Members of a chunk of a bucket; a task compares two chunks.
LISTED = 256

_rng = np.random.Generator(np.random.PCG64(71))
_ORDER = np.argsort(_rng.random((REGISTERS, REGISTERS)), axis=1)
_MIX = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * U(2) + U(1)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of REGISTERS 16-bit registers for each set; all zero for an empty set."""
    d = len(sets)
    value = np.full(d * REGISTERS, 1 << VALUE_BITS, np.uint64)
    if d and sum(map(len, sets)):
        h = np.concatenate(sets)
        bucket = ((h >> U(48)) * U(REGISTERS)) >> U(16)
        at = np.repeat(np.arange(d), [len(s) for s in sets]) * REGISTERS + bucket.astype(np.int64)
        np.minimum.at(value, at, h & U((1 << VALUE_BITS) - 1))
    empty = (value >> U(VALUE_BITS)).astype(bool).reshape(d, REGISTERS)
    fraction, exponent = np.frexp(value.astype(np.float64))
    zeros = np.minimum(VALUE_BITS - exponent, VALUE_BITS).astype(np.int64)
    code = (np.maximum(zeros, 0) << MANTISSA) | np.maximum(((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64), 0)
    code = code.astype(np.uint16).reshape(d, REGISTERS)
    full = ~empty.all(axis=1)
    code[~full] = 0
    rows, cols = np.nonzero(empty & full[:, None])
    filled = code.copy()
    for t in range(REGISTERS):
        if not len(rows):
            break
        donor = _ORDER[cols, t]
        has = ~empty[rows, donor]
        filled[rows[has], cols[has]] = code[rows[has], donor[has]]
        rows, cols = rows[~has], cols[~has]
    return filled


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers, corrected for chance agreement.

    Two unrelated registers agree if their minima have the same leading zeros and mantissa: summed over the number
    of zeros z, the product of both chances to fall in [2^-z-1, 2^-z), times 2^-MANTISSA.
    """
    same = (a == b).mean(axis=1)
    z = np.arange(VALUE_BITS)
    chance = np.ones(len(same))
    for n, first in ((n_a, True), (n_b, False)):
        load = (n / REGISTERS)[:, None]
        inside = np.exp(-load * 2.0 ** -(z + 1)) - np.exp(-load * 2.0**-z)
        chance = inside if first else (chance * inside).sum(axis=1) / (1 << MANTISSA)
    return (same - chance) / (1 - chance)


def _signer(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        for batch in batches:
            sets = list(shingle_sets(batch.column(1), size))
            codes = registers(sets)
            digests = [blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary())],
                names=["id", "n", "digest", "registers"],
            )

    return run


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def _band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        code = _codes(batch.column("registers")).reshape(-1, BANDS, ROWS).astype(np.uint64)
        keys = mixed((code * _MIX).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
        ids = np.repeat(batch.column("id").to_numpy(), BANDS)
        bands = np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids), pa.array(bands)], names=["key", "id", "band"])


def _least(percent: int, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The least estimate that is verified: five standard deviations below the threshold.

    A small set has few distinct minima, whatever the number of registers.
    """
    p = percent / 100
    return p - 5 * np.sqrt(p * (1 - p) / np.minimum(REGISTERS, np.maximum(n_a, n_b)))


def _estimator(percent: int):
    """Keeps pairs whose estimate is within five standard deviations of the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            found = estimate(_codes(batch.column("registers_a")), _codes(batch.column("registers_b")), n_a, n_b)
            yield batch.select(["a", "b"]).filter(pa.array(found >= _least(percent, n_a, n_b)))

    return run


def _verifier(size: int, percent: int):
    """Keeps pairs with 100 * intersection >= percent * union on the full sets: first of hashes, then of the words themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, held = [], None, None
            both = zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), shingle_sets(batch.column("text_b"), size))
            for text, text_b, other in both:
                if last != text:
                    last, held = text, next(shingle_sets(pa.array([text]), size))
                common = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(100 * common >= percent * (len(held) + len(other) - common) and linked(text, text_b, size, percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are links; pairs is a written table, and a may be in very many of them."""
    side = lambda s: nodes.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("registers").alias(f"registers_{s}"))
    sized = spread_join(pairs, side("a"), "a", "b").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    near = materialize(sized.mapInArrow(_estimator(percent), "a long, b long"), "near-pairs")
    text = lambda s: texts.select(F.col("id").alias(s), F.col("text").alias(f"text_{s}"))
    full = spread_join(near.join(text("b"), "b"), text("a"), "a", "b", counted=near).select("a", "b", "text_a", "text_b")
    return materialize(full.mapInArrow(_verifier(size, percent), "a long, b long").distinct(), "links")


def components(edges: DataFrame, label: str = "component") -> DataFrame:
    """(id, component) for the ends of edges (a, b): the smallest id that can be reached.

    Each round points every node at its smallest neighbour; of two that point at each other, the smaller is a root.
    Nodes then hop to the target of their target until all stand at their root, and edges become those between roots.
    So a round leaves at most half of the nodes and costs the logarithm of its longest path. The smallest id of a
    component is always a root. Nodes that point at one of very many are spread. Tables are written, and only their
    emptiness and numbers of rows come to the driver.
    """
    edges = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = None
    while labels is None or not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        nearest = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("to")), "hops")
        back = nearest.select(F.col("id").alias("to"), F.col("to").alias("back"))
        root = (F.col("back") == F.col("id")) & (F.col("id") < F.col("to"))
        hop = materialize(spread_join(nearest, back, "to", "id").select("id", F.when(root, F.col("id")).otherwise(F.col("to")).alias("to")), "hops")
        moved = True
        while moved:
            up = hop.select(F.col("id").alias("to"), F.col("to").alias("top"))
            higher = materialize(spread_join(hop, up, "to", "id").select("id", F.col("top").alias("to"), (F.col("top") != F.col("to")).alias("moved")), "hops")
            moved = not higher.where("moved").isEmpty()
            hop = higher.select("id", "to")
        if labels is None:
            labels = hop.withColumnRenamed("to", label)
        else:
            next_ = hop.withColumnRenamed("id", label)
            labels = materialize(labels.join(next_, label, "left").select("id", F.coalesce("to", label).alias(label)), "labels")
        at = lambda s: hop.select(F.col("id").alias(s), F.col("to").alias(f"to_{s}"))
        moved_to = edges.join(at("a"), "a").join(at("b"), "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        edges = materialize(moved_to.where("a <> b").distinct(), "edges")
    return labels


def _cell_links(size: int, percent: int):
    """Links between different components among a cell's members, found on their full sets.

    A cell compares the members of its first side with those of its second. A pair belongs to the bucket of the
    first band in which its registers agree, so no pair is looked at twice. Partners come in order of the estimate;
    links join components at once, which spares the rest of their pairs.
    """

    def run(table: pa.Table) -> pa.Table:
        ids, parts = table.column("id").to_pylist(), table.column("part").to_pylist()
        code, n = _codes(table.column("registers").combine_chunks()), table.column("n").to_numpy().astype(float)
        first = np.array(table.column("first_side").to_pylist(), bool)
        second, band = np.array(table.column("second_side").to_pylist(), bool), table.column("band")[0].as_py()
        texts = table.column("text").combine_chunks()
        sets: dict[int, np.ndarray] = {}
        root = {p: p for p in parts}

        def find(p: int) -> int:
            while root[p] != p:
                root[p] = p = root[root[p]]
            return p

        def set_of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = next(shingle_sets(texts.slice(i, 1), size))
            return sets[i]

        links: list[tuple[int, int]] = []
        banded = code.reshape(len(ids), BANDS, ROWS)
        for i in np.flatnonzero(first).tolist():
            own = find(parts[i])
            others = np.array([j for j in np.flatnonzero(second).tolist() if find(parts[j]) != own and (not first[j] or j > i or not second[i])], np.int64)
            if not len(others):
                continue
            agree = (banded[others] == banded[i]).all(axis=2)
            others = others[(agree.argmax(axis=1) == band) & agree[:, band]]
            others = others[100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])]
            if not len(others):
                continue
            found = estimate(code[others], np.broadcast_to(code[i], (len(others), REGISTERS)), n[others], np.full(len(others), n[i]))
            least = _least(percent, n[others], n[i])
            for at in np.argsort(-found, kind="stable").tolist():
                j = int(others[at])
                if found[at] < least[at] or find(parts[j]) == find(parts[i]):
                    continue
                a, b = set_of(i), set_of(j)
                common = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * common >= percent * (len(a) + len(b) - common) and linked(texts[i].as_py(), texts[j].as_py(), size, percent):
                    root[find(parts[j])] = find(parts[i])
                    links.append((ids[i], ids[j]))
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return run


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Texts are linked if 100 * |A and B| >= percent * |A or B| for their sets of shingles (runs of `shingle` words,
    A-Z in lower case; fewer words are one shingle). component_id is the smallest id that links reach, and kept
    says that it is the row's own. At a similarity of 0.8 a link escapes all bands with a chance of 5e-6.

    A null, empty or blank text has no shingles and is linked with nothing. Whole texts count, whatever their length.
    A null id takes no part: its component_id is null and it is kept. Rows with one id are in one component, linked by
    any of their texts. An empty table gives no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    signed = materialize(texts.mapInArrow(_signer(shingle), "id long, n long, digest binary, registers binary"), "signatures")
    nodes, hits = candidates(signed)
    equal = nodes.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    reps = nodes.where("id = first").select("id", "n", "registers")
    shared = hits.where("id <> pivot").groupBy("id", "pivot").agg(F.count("*").alias("bands"))  # more bands, more alike
    likest = shared.groupBy(F.col("id").alias("b")).agg(F.max(F.struct("bands", (-F.col("pivot")).alias("a"))).alias("top"))
    stars = materialize(likest.select((-F.col("top.a")).alias("a"), "b"), "stars")
    links = _confirmed(stars, reps, texts, shingle, percent)
    parts = components(links.union(equal), "part")
    others = open_stars(hits, parts, stars)
    if not others.isEmpty():
        parts = merged(parts, _confirmed(others, reps, texts, shingle, percent))
    more = open_links(hits, parts, reps, texts, shingle, percent)
    if more is not None:
        parts = merged(parts, more)
    result = signed.select("id", "n").join(parts, "id", "left").withColumn("component_id", F.coalesce("part", "id"))
    kept = F.col("id").isNull() | (F.col("component_id") == F.col("id"))
    return result.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Components (id, part) after more links (a, b), whose ends may be in no component yet."""
    named = lambda s: parts.select(F.col("id").alias(s), F.col("part").alias(f"part_{s}"))
    ends = links.join(named("a"), "a", "left").join(named("b"), "b", "left")
    joined = components(ends.select(F.coalesce("part_a", "a").alias("a"), F.coalesce("part_b", "b").alias("b")), "whole")
    every = parts.union(links.select("a", "a").union(links.select("b", "b")).distinct().join(parts.select(F.col("id").alias("a")), "a", "left_anti"))
    found = every.join(joined.withColumnRenamed("id", "part"), "part", "left").select("id", F.coalesce("whole", "part").alias("part"))
    return materialize(found, "parts")


def _open_hits(hits: DataFrame, parts: DataFrame) -> DataFrame:
    """hits with part, of the buckets whose members are in different components."""
    placed = hits.join(parts, "id", "left").withColumn("part", F.coalesce("part", "id"))
    mixed_ = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
    return placed.join(materialize(mixed_, "open-keys"), "key")


def open_stars(hits: DataFrame, parts: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a: pivot, b) of a bucket's pivot with members in other components, less the known ones."""
    open_ = materialize(_open_hits(hits, parts).select("key", "id", "pivot", "part"), "open-stars")
    tops = open_.where("id = pivot").select("key", F.col("part").alias("top"))
    pairs = open_.join(tops, "key").where("part <> top").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    return materialize(pairs.join(known, ["a", "b"], "left_anti"), "other-stars")


def candidates(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, digest, n, registers, first: smallest id with an equal set), and hits (key, id, pivot, members) of shared buckets.

    An id with several texts has a node for each of its sets, and enters buckets with all of them.
    """
    usable = signed.where("n > 0 and id is not null")
    classes = materialize(usable.groupBy("digest").agg(F.min("id").alias("first")), "classes")
    nodes = materialize(spread_join(usable, classes, "digest", "id").select("id", "digest", "n", "registers", "first").dropDuplicates(["id", "digest"]), "nodes")
    bands = nodes.where("id = first").select("id", "registers").mapInArrow(_band_keys, "key long, id long, band int")
    shared = bands.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("members")).where("members > 1")
    hits = materialize(bands.join(materialize(shared, "shared-keys"), "key"), "hits")  # from a table: a large bucket can be split
    return nodes, hits


def open_links(hits: DataFrame, parts: DataFrame, reps: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame | None:
    """Links between members of one bucket that are still in different components; None if there is no such bucket.

    A bucket's members outside its largest component are compared with that component and with each other, chunk by
    chunk, so that a bucket of any size is spread over tasks of at most two chunks. Buckets of two are known.
    """
    open_ = materialize(_open_hits(hits, parts).where("members > 2").select("key", "band", "id", "members", "part"), "open-hits")
    if open_.isEmpty():
        return None
    sizes = open_.groupBy("key", "part").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "part")).alias("top"), F.sum("m").alias("all"))
    chunks = lambda n: F.ceil(n / LISTED).cast("int")
    sizes = sizes.select("key", F.col("top.part").alias("top"), chunks(F.col("top.m")).alias("large"), chunks(F.col("all") - F.col("top.m")).alias("small"))
    sided = open_.join(materialize(sizes, "open-sizes"), "key").withColumn("is_top", F.col("part") == F.col("top"))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("is_top"), F.col("large")).otherwise(F.col("small"))).cast("int")
    upto = lambda lo, hi: F.sequence(lo, hi)
    zero = F.lit(0)
    # cells (small chunk, "t", large chunk) and (small chunk, "s", small chunk), the first not after the second
    with_top = F.when(F.col("is_top"), F.transform(upto(zero, F.col("small") - 1), lambda i: F.struct(i.alias("i"), F.lit("t").alias("kind"), F.col("own").alias("j"), F.lit(False).alias("first_side"), F.lit(True).alias("second_side"))))
    to_top = F.transform(upto(zero, F.col("large") - 1), lambda j: F.struct(F.col("own").alias("i"), F.lit("t").alias("kind"), j.alias("j"), F.lit(True).alias("first_side"), F.lit(False).alias("second_side")))
    among = F.transform(upto(zero, F.col("small") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.lit("s").alias("kind"), F.greatest(k, F.col("own")).alias("j"), (F.col("own") <= k).alias("first_side"), (F.col("own") >= k).alias("second_side")))
    cells = sided.withColumn("own", own).withColumn("cell", F.explode(F.coalesce(with_top, F.concat(to_top, among))))
    slim = cells.select("key", "band", "id", "part", "cell.*")
    held = reps.select("id", "n", "registers").join(texts, "id")
    full = slim.join(held, "id")
    found = full.groupBy("key", "i", "kind", "j").applyInArrow(_cell_links(size, percent), "a long, b long")
    return materialize(found.distinct(), "open-links")
