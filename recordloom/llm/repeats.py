"""Removal of repeated byte strings by blockwise suffix sorting.

A byte goes if a string of `length` bytes that covers it also starts elsewhere. Every such string holds an anchor:
the smallest of its GRAM-byte hashes. Strings that start one after the other share their anchor over a run, and
equal strings have equal anchors at equal places. So anchors deal the suffixes of all texts to buckets that can be
sorted one at a time, and only these are:

1. A pass over the texts fills a Bloom filter of anchors seen twice; a second lists the runs (anchor, place, digest
   of the run's bytes) that pass it. An anchor seen once can't repeat; runs with equal digests repeat throughout.
2. Of anchors with runs that are alone with their digest, one run for each digest is read again, and
   suffixes of an anchor's bucket are sorted as far as `length` bytes: by their first COVER bytes, then by
   ranks of the sample of positions that a difference cover picks, which stand for the bytes between. Suffixes
   that share all of that with a neighbour in the order repeat.
3. Buckets with too many runs for one task are split by more of their bytes first. Runs are cut into pieces of up to
   STEP suffixes at the same distances from the anchor; the bytes that all suffixes of a piece share (its core) deal
   pieces to parts, and parts are sorted like buckets. The suffixes of a part that is still too large differ in STEP - 1
   bytes around the core, and splitting the part by these leaves nothing to sort.
4. Repeated stretches of a text are united and cut out.
"""

from __future__ import annotations

from collections.abc import Iterator


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm import bloom
from recordloom.llm.shingles import _chunks, _grown, mixed
from recordloom.llm.work import materialize, small_batches

U = np.uint64
GRAM = 48
#: Bytes compared directly, and the period of the difference cover.
COVER = 32
#: Distinct runs of a bucket, or pieces of a part, that a task sorts; larger ones are split by more of their bytes.
SORTED = 512
#: Suffixes in a piece of a run of a larger bucket.
STEP = 16
#: Slots of keys that may be spread, and the most ways a key's rows are spread to.
SLOTS, WAYS = 1 << 16, 256
#: Bytes of runs sorted at once.
BLOCK = 1 << 20
#: Low bits of an ordering hash that give way to the place; longer texts are listed in overlapping slices.
PLACE_BITS = 24
SLICE = 1 << (PLACE_BITS - 1)
ROW = pa.struct([("id", pa.int64()), ("tag", pa.int64())])
_OWN = np.random.Generator(np.random.PCG64(19)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


def difference_cover(v: int) -> list[int]:
    """A set D of residues such that every difference modulo v is one of two members, found greedily."""
    cover, open_ = [0], set(range(1, v))
    while open_:
        best = max(range(v), key=lambda c: (len({(c - d) % v for d in cover} & open_) + len({(d - c) % v for d in cover} & open_), -c))
        cover.append(best)
        open_ -= {(a - b) % v for a in cover for b in cover}
    return sorted(cover)


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of data[i:i + size] for every i; bytes count as they are."""
    n = len(data)
    if n < size:
        return np.zeros(0, np.uint64)
    power, inverse = _grown(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_OWN[data] * power[:n], out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * inverse[: n - size + 1])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i:i + width] for every i, by doubling."""
    span, out = 1, x
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _runs(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, first start, starts, anchor place, anchor hash) of each run in texts data[bounds[i]:bounds[i + 1]]."""
    grams = _gram_hashes(data, GRAM)
    width = length - GRAM + 1
    if len(grams) < width:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    bits = U(PLACE_BITS)
    at = np.arange(len(grams), dtype=np.uint64)
    low = _sliding_min((grams >> bits << bits) | at, width)  # of equal hashes, the leftmost
    anchor = (low & ((U(1) << bits) - U(1))).astype(np.int64)
    start = np.arange(len(anchor))
    text = np.searchsorted(bounds, start, "right") - 1
    usable = start + length <= bounds[text + 1]
    start, text, anchor = start[usable], text[usable], anchor[usable]
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    return text[first], start[first], count, anchor[first], grams[anchor[first]]


def _in_slice(data: np.ndarray, at: int, length: int) -> tuple[np.ndarray, ...]:
    """Runs of one long text whose starts lie in a slice."""
    part = data[at : at + SLICE + length - 1]
    text, start, count, anchor, hashed = _runs(part, np.array([0, len(part)]), length)
    return text, start + at, count, anchor + at, hashed


def _listed(texts: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, tuple[np.ndarray, ...]]]:
    """(bytes, bounds, index of the first text, runs) of each chunk of texts."""
    base = 0
    for data, bounds in _chunks(texts):
        found = [_runs(data, bounds, length)] if len(data) <= SLICE else [_in_slice(data, at, length) for at in range(0, len(data), SLICE)]
        yield data, bounds, base, tuple(np.concatenate(c) for c in zip(*found))
        base += len(bounds) - 1


def _anchors(length: int) -> bloom.Hashes:
    return lambda batch: np.concatenate([np.zeros(0, np.uint64)] + [runs[4] for _, _, _, runs in _listed(batch.column(1), length)])


RUN = "anchor long, digest long, row struct<id:long,tag:long>, start long, n int, place int"


def _run_key(anchor: np.ndarray, digest: np.ndarray, tag: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash of one run, and not of its copies."""
    u = lambda x: np.ascontiguousarray(x).view(np.uint64)
    return mixed(u(anchor) ^ u(digest) ^ mixed(u(tag) + u(start.astype(np.int64))))


def _lister(length: int, anchors, wanted=None):
    """Runs (see RUN) whose anchor passes the filter anchors; with a filter wanted, those that pass it, and their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = np.frombuffer(anchors.value, np.uint8)
        asked = None if wanted is None else np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            for data, bounds, base, (text, start, count, anchor, hashed) in _listed(batch.column(1), length):
                use = bloom.may_contain(repeated, hashed)
                text, start, count, anchor, hashed = (c[use] for c in (text, start, count, anchor, hashed))
                view = memoryview(np.ascontiguousarray(data))
                spans = list(zip(start.tolist(), (start + count - 1 + length).tolist(), (anchor - start).tolist()))
                digest = np.array([xxhash.xxh3_64_intdigest(view[a:b], seed=p) for a, b, p in spans], np.uint64)
                tags = batch.column(0).field("tag").to_numpy()[text + base]
                pick = np.arange(len(digest)) if asked is None else np.flatnonzero(bloom.may_contain(asked, _run_key(hashed, digest, tags, start - bounds[text])))
                if not len(pick):
                    continue
                columns = [
                    pa.array(hashed[pick].view(np.int64)),
                    pa.array(digest[pick].view(np.int64)),
                    batch.column(0).take(pa.array(text[pick] + base)),
                    pa.array((start - bounds[text])[pick].astype(np.int64)),
                    pa.array(count[pick].astype(np.int32)),
                    pa.array((anchor - start)[pick].astype(np.int32)),
                ]
                names = ["anchor", "digest", "row", "start", "n", "place"]
                if asked is not None:
                    columns.append(pa.array([bytes(view[spans[i][0] : spans[i][1]]) for i in pick.tolist()], pa.binary()))
                    names.append("bytes")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _equal_neighbours(keys: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Of rows, those that agree with another row in all keys; they are sorted key by key, and lone rows leave early."""
    group = np.zeros(len(rows), np.int64)
    for key in keys:
        if not len(rows):
            break
        value = key[rows]
        order = np.lexsort((value, group))
        rows, group, value = rows[order], group[order], value[order]
        new = np.ones(len(rows), bool)
        new[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
        group = np.cumsum(new)
        twin = np.zeros(len(rows), bool)
        twin[1:] = ~new[1:]
        twin[:-1] |= ~new[1:]
        rows, group = rows[twin], group[twin]
    return rows


def _words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a big-endian number; past the end, zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for i in range(8):
        out = (out << U(8)) | padded[i : i + len(data)]
    return out


def repeated_suffixes(data: np.ndarray, starts: np.ndarray, bucket: np.ndarray, residue: np.ndarray, length: int) -> np.ndarray:
    """Of suffixes data[starts:], those whose first `length` bytes equal another's of the same bucket.

    residue: starts modulo COVER; suffixes of one bucket must agree in it (runs are laid out that way). Sample
    positions are ranked by COVER bytes, then by doubling, since position + COVER is a sample position as well.
    """
    cover = np.array(difference_cover(COVER))
    words = _words_at(data)
    chosen = np.zeros(COVER, bool)
    chosen[cover] = True
    sample = np.flatnonzero(chosen[np.arange(len(data)) % COVER])
    where = np.full(len(data) + COVER + 1, -1)
    where[sample] = np.arange(len(sample))

    def ranked(keys: list[np.ndarray]) -> np.ndarray:
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order), bool)
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        return rank

    at = lambda p: np.where(p < len(words), words[np.minimum(p, len(words) - 1)], 0)
    rank, depth = ranked([at(sample + i) for i in range(0, COVER, 8)]), COVER
    while 4 * depth <= length:  # leaves room for a lookup on either side
        beyond = sample + depth
        next_ = np.where(beyond < len(data), rank[where[np.minimum(beyond, len(data) - 1)]], -1)
        rank, depth = ranked([rank, next_]), 2 * depth
    # lookups: the first sample position at or after each of these offsets stands for `depth` bytes
    ahead = np.array([next(d for d in range(COVER) if chosen[(r + d) % COVER]) for r in range(COVER)])
    keys = [at(starts + i) for i in range(0, COVER, 8)]
    known = COVER  # bytes [0, known) are compared
    while known + depth <= length:
        offset = known - COVER + 1
        offset = offset + ahead[(residue + offset) % COVER]  # at most `known`, the same for a whole bucket
        keys.append(rank[where[starts + offset]])
        known = known - COVER + 1 + depth
    keys.extend(at(starts + i) for i in [*range(known, length - 8, 8), length - 8])
    return _equal_neighbours([bucket, *keys], np.arange(len(starts)))


def _sorter(length: int):
    """Buckets (one row each, with lists of runs) to repeated stretches (row, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple[int, dict]] = []
        size, bucket = 0, 0

        def done() -> pa.RecordBatch:
            nonlocal size
            pieces, total = [], 0
            for _, r in pending:  # an anchor stands at a multiple of COVER
                gap = -(total + r["place"]) % COVER
                pieces.append(b"\0" * gap + r["bytes"])
                r["at"] = total + gap
                total += gap + len(r["bytes"])
            data = np.frombuffer(b"".join(pieces), np.uint8)
            own = np.repeat(np.arange(len(pending)), [r["n"] for _, r in pending])
            shift = np.concatenate([np.arange(r["n"]) for _, r in pending])
            starts = np.array([r["at"] for _, r in pending])[own] + shift
            ahead = np.array([r["place"] for _, r in pending])[own] - shift  # from the suffix to its anchor
            where = np.array([b for b, _ in pending], np.int64)[own] * (length + 1) + ahead
            twins = np.sort(repeated_suffixes(data, starts, where, starts % COVER, length))
            lone = np.array([r["lone"] for _, r in pending], bool)[own]
            twins = twins[lone[twins]]
            rows, begin, end = [], [], []
            if len(twins):
                cut = np.flatnonzero((np.diff(twins) != 1) | (np.diff(own[twins]) != 0)) + 1
                for lo, hi in zip(np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [len(twins)]]).tolist()):
                    r = pending[own[twins[lo]]][1]
                    rows.append(r["row"])
                    begin.append(r["start"] + int(shift[twins[lo]]))
                    end.append(r["start"] + int(shift[twins[hi - 1]]) + length)
            pending.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(rows, ROW), pa.array(begin, pa.int64()), pa.array(end, pa.int64())], names=["row", "begin", "end"])

        for batch in batches:
            for runs in (bucket_.as_py() for bucket_ in batch.column(0)):  # one bucket at a time
                bucket += 1
                pending.extend((bucket, r) for r in runs)
                size += sum(len(r["bytes"]) for r in runs)
                if size >= BLOCK:
                    yield done()
        if pending:
            yield done()

    return run


def _signed(digest: int) -> int:
    return digest - (1 << 64) if digest >> 63 else digest


def _pieces(length: int):
    """Runs of large buckets in pieces, each with a digest of its core and one of all its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "core", "digest", "row", "start", "n", "place", "lone", "bytes"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), ROW, pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                at = 0
                while at < r["n"]:
                    ahead = r["place"] - at
                    n = min(r["n"] - at, ahead % STEP + 1)
                    raw = r["bytes"][at : at + n - 1 + length]
                    core = xxhash.xxh3_64_intdigest(raw[ahead % STEP : ahead % STEP + length - STEP + 1], seed=ahead // STEP)
                    digest = xxhash.xxh3_64_intdigest(raw, seed=ahead)
                    rows.append((r["anchor"], _signed(core), _signed(digest), r["row"], r["start"] + at, n, ahead, r["lone"], raw))
                    at += n
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=names)

    return run


def _around_core(length: int):
    """Each suffix of large parts with its bytes before and after the core: STEP - 1 in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "core", "place", "around", "row", "start", "lone"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), ROW, pa.int64(), pa.bool_()]
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                for i in range(r["n"]):
                    raw, before = r["bytes"][i : i + length], (r["place"] - i) % STEP
                    around = raw[:before] + raw[before + length - STEP + 1 :]
                    rows.append((r["anchor"], r["core"], r["place"] - i, around, r["row"], r["start"] + i, r["lone"]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=names)

    return run


def _spread(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """rows whose values of `on` are among keys, which hold each once with its number of rows in copies.

    The rows of a key that has more than its share go WAYS ways at most. A broadcast table says how many; it
    has a row for each slot (a hash of `on`) that holds such a key, so SLOTS rows at most.
    """
    share = max(1024, rows.count() // 4096)
    slot = F.pmod(F.xxhash64(*on), F.lit(SLOTS))
    hot = keys.groupBy(slot.alias("slot")).agg(F.max("copies").alias("most")).where(F.col("most") > share)
    hot = F.broadcast(hot.select("slot", F.least(F.ceil(F.col("most") / share), F.lit(WAYS)).alias("ways")))
    ways = F.coalesce("ways", F.lit(1).cast("long"))
    left = rows.withColumn("slot", slot).join(hot, "slot", "left").withColumn("way", F.pmod(F.xxhash64("row", "start"), ways))
    right = keys.select(*on, slot.alias("slot")).join(hot, "slot", "left").select(*on, F.explode(F.sequence(F.lit(0).cast("long"), ways - 1)).alias("way"))
    return left.drop("slot", "ways").join(right, [*on, "way"]).drop("way")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, spans) to id, n_bytes, n_removed, n_spans and the text left as bytes and digest."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for doc, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
            raw = (text or "").encode()
            kept, at, n = [], 0, 0
            last = -1
            for s in sorted(spans or [], key=lambda s: (s["begin"], s["end"])):
                if s["begin"] > last:
                    n += 1
                    kept.append(raw[at : s["begin"]])
                last = max(last, s["end"])
                at = last
            kept.append(raw[at:])
            left = b"".join(kept)
            for column, value in zip(out, (doc, len(raw), len(raw) - len(left), n, left)):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200, bits_per_anchor: int = 16, max_bits: int = 1 << 28) -> DataFrame:
    """Cuts out every byte of a text's UTF-8 form that a string of `length` bytes, found elsewhere too, covers.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed stretches) and kept (the bytes left, which may
    end within a character). Strings are judged on the input; both places lose them, within one text as well, and
    overlaps count. length is at least 136.

    Filters have bits_per_anchor bits for each key and max_bits (32 MB, broadcast) at most; beyond that more runs
    are listed, and results stay exact. A null text counts as empty. Ids may be null or repeated: rows are known by
    id and text, and rows equal in both are two places. An empty table gives no rows; other columns are ignored.
    """
    if length < GRAM + 88:
        raise ValueError(f"length must be at least {GRAM + 88}")
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keyed = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    keyed = keyed.withColumn("row", F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("tag")))
    texts = keyed.select("row", "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bloom.bits_for(2 * size // (length - GRAM + 1), bits_per_anchor, max_bits)
    anchors = spark.sparkContext.broadcast(bloom.twice_seen(texts, _anchors(length), bits))
    runs = materialize(texts.mapInArrow(_lister(length, anchors), RUN), "repeat-runs")

    by_digest = runs.groupBy("anchor", "digest").agg(F.count("*").alias("copies"), F.min(F.struct("row", "start")).alias("one"))
    by_digest = materialize(by_digest, "repeat-digests")
    lone = F.col("copies") == 1
    by_anchor = by_digest.groupBy("anchor").agg(F.count("*").alias("kinds"), F.max(lone).alias("any_lone"), F.sum("copies").alias("all"))
    stretch = ["row", F.col("start").alias("begin"), (F.col("start") + F.col("n") - 1 + length).alias("end")]
    whole = _spread(runs, by_digest.where("copies > 1").select("anchor", "digest", "copies"), ["anchor", "digest"]).select(stretch)

    split_up = materialize(by_anchor.where("kinds > 1 and any_lone").select("anchor", "kinds"), "repeat-buckets")
    open_ = materialize(by_digest.join(split_up, "anchor").select("anchor", "digest", "kinds", lone.alias("lone"), "one.*"), "repeat-open")
    bits = bloom.bits_for(open_.count(), bits_per_anchor, max_bits)
    keys = lambda batch: _run_key(*[batch.column(i).to_numpy() for i in range(4)])
    wanted = spark.sparkContext.broadcast(bloom.once_seen(open_.select("anchor", "digest", "row.tag", "start"), keys, bits))
    read = texts.mapInArrow(_lister(length, anchors, wanted), RUN + ", bytes binary")
    read = materialize(read.join(open_, ["anchor", "digest", "row", "start"]), "repeat-read").drop("digest")
    row = "row struct<id:long,tag:long>"
    runs_of = lambda df, *key: df.groupBy(*key).agg(F.collect_list(F.struct("row", "start", "n", "place", "lone", "bytes")).alias("runs")).select("runs")

    pieces = read.where(f"kinds > {SORTED}").drop("kinds").mapInArrow(_pieces(length), f"anchor long, core long, digest long, {row}, start long, n int, place int, lone boolean, bytes binary")
    pieces = materialize(pieces, "repeat-pieces")
    piece = ["anchor", "core", "digest"]
    kinds = materialize(pieces.groupBy(*piece).agg(F.count("*").alias("copies"), F.min(F.struct("row", "start")).alias("one")), "repeat-kinds")
    equal = _spread(pieces.where("lone").drop("bytes"), kinds.where("copies > 1").select(*piece, "copies"), piece).select(stretch)
    parts = kinds.groupBy("anchor", "core").agg(F.count("*").alias("kinds")).where("kinds > 1")
    firsts = kinds.join(parts, ["anchor", "core"]).select(*piece, "one.*", "copies", "kinds")
    ones = pieces.join(firsts, [*piece, "row", "start"]).withColumn("lone", F.expr("lone and copies = 1")).drop("digest", "copies")
    ones = materialize(ones, "repeat-parts")
    sortable = runs_of(read.where(f"kinds <= {SORTED}"), "anchor").unionByName(runs_of(ones.where(f"kinds <= {SORTED}"), "anchor", "core"))
    sorted_ = sortable.mapInArrow(_sorter(length), f"{row}, begin long, end long")
    suffixes = ones.where(f"kinds > {SORTED}").drop("kinds").mapInArrow(_around_core(length), f"anchor long, core long, place int, around binary, {row}, start long, lone boolean")
    suffixes = materialize(suffixes, "repeat-suffixes")
    suffix = ["anchor", "core", "place", "around"]
    twins = materialize(suffixes.groupBy(*suffix).agg(F.count("*").alias("copies")).where("copies > 1"), "repeat-twins")
    split = _spread(suffixes.where("lone"), twins, suffix).select("row", F.col("start").alias("begin"), (F.col("start") + length).alias("end"))

    found = whole.unionByName(sorted_).unionByName(equal).unionByName(split).groupBy("row").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    joined = keyed.join(found, "row", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
