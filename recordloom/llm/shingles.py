"""Vectorised hashing of words and shingles over Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

from recordloom.llm.words import chunks, words

U = np.uint64
#: Bytes of text hashed at once.
CHUNK = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BASE = int(_rng.integers(1, 1 << 63, dtype=np.uint64)) * 2 + 1
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, CHUNK), U(base % (1 << 64)))
            steps[0] = U(1)
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all 64."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words before each text's end) for texts data[bounds[i]:bounds[i + 1]].

    Each distinct word is hashed by BLAKE2, so that words can't be made that collide; A-Z counts as a-z.
    """
    found, upto = words(_LOWER[data], bounds)
    coded = found.dictionary_encode()
    distinct = b"".join(blake2b(w, digest_size=8).digest() for w in coded.dictionary.cast(pa.binary()).to_pylist())
    return np.frombuffer(distinct, U)[coded.indices.to_numpy()], upto


def _chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, bounds) of runs of whole texts, about CHUNK bytes each."""
    for _, data, bounds in chunks(texts, CHUNK):
        yield data, bounds


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: runs of `size` words, A-Z in lower case.

    A text with fewer words is one shingle; one without words (or null) has none.
    """
    for data, bounds in _chunks(texts):
        hashes, upto = _word_hashes(data, bounds)
        n = len(hashes)
        sums = np.zeros(max(0, n - size + 1), np.uint64)
        for i in range(size):
            sums += hashes[i : i + len(sums)] * _PLACE[i]
        sums = mixed(sums)
        begin = 0
        for end in upto.tolist():
            count = end - begin
            if count >= size:
                yield np.unique(sums[begin : end - size + 1])
            elif count:
                yield mixed((hashes[begin:end] * _PLACE[:count]).sum(keepdims=True) + U(count))
            else:
                yield np.zeros(0, np.uint64)
            begin = end


def linked(one: str, other: str, size: int, percent: int) -> bool:
    """Whether 100 * |A and B| >= percent * |A or B| for the shingle sets of two texts, told by the words themselves."""
    (_, data, bounds), = chunks(pa.array([one, other]), 1 << 62)
    found, (cut, n) = words(_LOWER[data], bounds)
    ids = found.dictionary_encode().indices.to_numpy().astype(np.int64)
    many = int(ids.max(initial=0)) + 1
    length = min(size, max(cut, n - cut))
    if not cut or not n - cut or min(size, cut) != min(size, n - cut):
        return False
    key, values = ids[: n - length + 1], many
    for i in range(1, length):
        if values > (1 << 62) // many:
            key = np.unique(key, return_inverse=True)[1]
            values = len(key)
        key = key * many + ids[i : i + n - length + 1]
        values *= many
    a, b = np.unique(key[: cut - length + 1]), np.unique(key[cut:])
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)
