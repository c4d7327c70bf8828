"""Bloom filters over 64-bit hashes that are built in the tasks and merged segment by segment.

Filters have a size that a parameter bounds, so they may be broadcast. More keys than that is good for make them
answer "maybe" more often; they never deny a key that was added.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT_BITS = 1 << 20
HASHES = 2

#: From a batch, the hashes of what it adds.
Hashes = Callable[[pa.RecordBatch], np.ndarray]


def bits_for(keys: int, bits_per_key: int = 16, most: int = 1 << 28) -> int:
    """A power of two, between one segment and `most` (32 MB)."""
    return max(SEGMENT_BITS, min(most, 1 << int(keys * bits_per_key).bit_length()))


def positions(h: np.ndarray, bits: int) -> np.ndarray:
    """HASHES bit positions of each hash."""
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(low + np.uint64(i) * high) & np.uint64(bits - 1) for i in range(HASHES)], axis=1)


def may_contain(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = positions(h, 8 * len(bitmap))
    return ((bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1).astype(bool)


def _squeeze(bitmap: np.ndarray) -> bytes:
    return zlib.compress(bitmap.tobytes(), 1)


def _expand(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def _builder(hashes: Hashes, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            added = hashes(batch)
            if not len(added):
                continue
            where = np.sort(positions(added, bits).ravel())
            first = np.ones(len(where), bool)
            first[1:] = where[1:] != where[:-1]
            split = lambda at: ((at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
            byte, bit = split(where[first])
            np.bitwise_or.at(twice, byte, once[byte] & bit)
            np.bitwise_or.at(once, byte, bit)
            np.bitwise_or.at(twice, *split(where[~first]))
        task, step = TaskContext.get().partitionId(), SEGMENT_BITS // 8
        for s in range(0, bits // 8, step):
            if once[s : s + step].any():
                yield pa.RecordBatch.from_pydict({"segment": pa.array([s // step], pa.int32()), "task": pa.array([task], pa.int32()), "once": [_squeeze(once[s : s + step])], "twice": [_squeeze(twice[s : s + step])]})

    return run


def _merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A bit is set twice if either side says so, or both have it once."""
    once, twice = None, None
    for a, b in zip(table.column("once"), table.column("twice")):
        o, t = _expand(a.as_py()), _expand(b.as_py())
        once, twice = (o, t) if once is None else (once | o, twice | t | (once & o))
    return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "task": pa.array([0], pa.int32()), "once": [_squeeze(once)], "twice": [_squeeze(twice)]})


def _built(rows: DataFrame, hashes: Hashes, bits: int, column: str) -> bytes:
    """One of the merged bitmaps: bits / 8 bytes on the driver."""
    schema = "segment int, task int, once binary, twice binary"
    parts = rows.mapInArrow(_builder(hashes, bits), schema)
    fold = parts.withColumn("task", F.expr("task % 64")).groupBy("segment", "task").applyInArrow(_merge, schema)
    whole = np.zeros(bits // 8, np.uint8)
    for row in fold.groupBy("segment").applyInArrow(_merge, schema).select("segment", column).toLocalIterator():
        at = row["segment"] * (SEGMENT_BITS // 8)
        whole[at : at + SEGMENT_BITS // 8] = _expand(bytes(row[column]))
    return whole.tobytes()


def twice_seen(rows: DataFrame, hashes: Hashes, bits: int) -> bytes:
    """A filter of the hashes that rows add more than once (and some others)."""
    return _built(rows, hashes, bits, "twice")


def once_seen(rows: DataFrame, hashes: Hashes, bits: int) -> bytes:
    """A filter of all hashes that rows add (and some others)."""
    return _built(rows, hashes, bits, "once")
