"""Words of texts in Arrow buffers, cut out without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once, unless one text has more.
CHUNK = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def chunks(texts: pa.Array, chunk: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds) of runs of whole texts, about `chunk` bytes each; a null text is empty."""
    chunk = CHUNK if chunk is None else chunk
    big = texts.cast(pa.large_string()).fill_null("")
    buffers = big.buffers()
    bounds = np.frombuffer(buffers[1], np.int64)[big.offset : big.offset + len(big) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < len(big):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + chunk, "right")) - 1)
        yield at, data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(all words, number of words before each text's end) of the texts data[bounds[i]:bounds[i + 1]].

    A word is a longest run of bytes other than 0x20 and 0x09-0x0D inside one text.
    """
    word = ~_BLANK[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    full = bounds[:-1] < bounds[1:]
    firsts = bounds[:-1][full]
    start[firsts] |= word[firsts]
    end = word.copy()
    end[:-1] &= ~word[1:]
    lasts = bounds[1:][full] - 1
    end[lasts] |= word[lasts]
    starts = np.flatnonzero(start)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(np.flatnonzero(end) + 1 - starts, out=offsets[1:])
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[word]))
    return found, np.searchsorted(starts, bounds[1:])
