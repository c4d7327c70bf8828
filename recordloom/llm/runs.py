"""Periodic runs of words by the runs theorem.

A run is a longest stretch of words that keeps a smallest period p and spans it at least twice. Every run has a place
where the longest Lyndon word that starts there, under the order of words or under its inverse, is one period of the
run. So each place yields two candidates: [i, j), j being the next place whose suffix is smaller, from the inverse suffix
array. A candidate is extended to the right by the common prefix of suffixes i and j, to the left by that of
the reversed text: minima of the array of longest common prefixes, looked up in a sparse table.

Texts are sorted together, about a megabyte at a time, with the text's number as leading letter, so that suffixes of
different texts are never compared. Nothing is shuffled: a text's runs are its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.words import chunks, words
from recordloom.llm.work import small_batches

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order that sorts key, place in it of each entry's first equal, whether it has no other equal)."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    edge = np.ones(len(key) + 1, bool)
    np.not_equal(ordered[1:], ordered[:-1], out=edge[1:-1])
    first = np.maximum.accumulate(np.where(edge[:-1], np.arange(len(key)), 0))
    return order, first, edge[:-1] & edge[1:]


def suffix_ranks(text: np.ndarray, code: np.ndarray, upto: int | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Sorts the suffixes of each text by doubling: (ranks, names of windows of 1, 2, 4, ... letters, undecided places).

    code holds each text's letters, from 1, and a 0 at its end, smaller than any letter; text numbers the texts. Each
    round sorts only places whose window is not alone yet. With upto, it ends at windows of that many letters.
    """
    n, width = len(code), int(code.max(initial=0)) + 1
    single = text * width + code
    key = single * width
    key[:-1] += np.where(code[:-1] > 0, code[1:], 0)
    order, first, alone = _grouped(key)
    rank = np.empty(n, np.int64)
    rank[order] = first
    names, open_, size = [single], order[~alone], 2
    while len(open_) and (upto is None or size < upto):
        names.append(rank.copy())
        own = rank[open_]
        order, first, alone = _grouped(own << 32 | rank[open_ + size])
        open_, own = open_[order], own[order]
        start = np.maximum.accumulate(np.where(np.r_[True, own[1:] != own[:-1]], np.arange(len(own)), 0))
        rank[open_] = own + first - start
        open_, size = open_[~alone], size * 2
    return rank, names, open_


def common_prefixes(rank: np.ndarray, names: list[np.ndarray]) -> np.ndarray:
    """The longest common prefix of each suffix, in sorted order, with the one before it."""
    at = np.empty(len(rank), np.int64)
    at[rank] = np.arange(len(rank))
    a, b = at[:-1].copy(), at[1:].copy()
    lcp = np.zeros(len(rank), np.int32)
    for i in range(len(names) - 1, -1, -1):
        same = names[i][a] == names[i][b]
        step = same.astype(np.int64) << i
        a += step
        b += step
        lcp[1:] += step.astype(np.int32)
    return lcp


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Minima of values over windows of 1, 2, 4, ... entries."""
    table, size = [values.astype(np.int32)], 1
    while 2 * size <= len(values):
        table.append(np.minimum(table[-1][:-size], table[-1][size:]))
        size *= 2
    return table


def extensions(table: list[np.ndarray], rank: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many letters the suffixes at a and at b, which differ, have in common: minima of lcp between their ranks."""
    low, high = np.minimum(rank[a], rank[b]) + 1, np.maximum(rank[a], rank[b])
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    out = np.zeros(len(a), np.int64)
    for k in range(len(table)):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[k][low[at]], table[k][high[at] - (1 << k) + 1])
    return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller rank (the number of places if there is none), by descent in a sparse table."""
    table = sparse_table(rank)
    at = np.arange(1, len(rank) + 1)
    for k in range(len(table) - 1, -1, -1):
        go = np.flatnonzero(at < len(table[k]))
        go = go[table[k][at[go]] > rank[go]]
        at[go] += 1 << k
    return at


def runs_of(text: np.ndarray, code: np.ndarray, min_length: int) -> np.ndarray:
    """Rows (start, end, period) of the runs of at least min_length letters, ascending; places count over all texts."""
    start_of = np.r_[0, np.flatnonzero(code == 0)[:-1] + 1]
    end_of = np.flatnonzero(code == 0)
    nth = np.cumsum(np.r_[0, code[:-1] == 0])
    mirror = start_of[nth] + end_of[nth]  # place x of a text is place mirror - 1 - x of the reversed text
    back = np.where(code > 0, mirror - 1 - np.arange(len(code)), np.arange(len(code)))
    rank, names, _ = suffix_ranks(text, code)
    ahead = sparse_table(common_prefixes(rank, names))
    inverse = suffix_ranks(text, np.where(code > 0, code.max(initial=0) + 1 - code, 0))[0]
    behind_rank, names, _ = suffix_ranks(text, code[back])
    behind = sparse_table(common_prefixes(behind_rank, names))
    del names
    letters = np.flatnonzero(code)
    found = []
    for order in (rank, inverse):
        i, j = letters, next_smaller(order)[letters]
        end = j + extensions(ahead, rank, i, j)
        start = i - extensions(behind, behind_rank, mirror[i] - i, mirror[i] - j)
        period = j - i
        long = end - start >= np.maximum(min_length, 2 * period)
        found.append(np.stack([start[long], end[long], period[long]], axis=1))
    every = np.unique(np.concatenate(found), axis=0)
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def _search(data: np.ndarray, bounds: np.ndarray, min_length: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(words, runs, collapsed text) of each text of a chunk."""
    every, upto = words(data, bounds)
    counts = np.diff(upto, prepend=0)
    texts, n = len(counts), len(every)
    owner = np.repeat(np.arange(texts), counts)
    ids = every.dictionary_encode().indices.to_numpy() if n else np.zeros(0, np.int32)
    place = np.arange(n) + owner  # each text ends with one place more
    text, code = np.repeat(np.arange(texts), counts + 1), np.zeros(n + texts, np.int64)
    code[place] = ids.astype(np.int64) + 1
    some = np.full(texts, min_length < 3)
    if min_length >= 3:  # a run has a window of half of min_length twice; texts without one have no run
        _, _, again = suffix_ranks(text, code, 1 << ((min_length + 1) // 2).bit_length() - 1)
        some[text[again]] = True
    inside = np.flatnonzero(some[text])
    found = np.zeros((0, 3), np.int64)
    if len(inside):
        found = runs_of(text[inside], code[inside], min_length)
        found[:, 1] -= found[:, 0]
        begin = inside[found[:, 0]]
        found[:, 0] = begin - text[begin]  # among all words
    start, length, period = found.T
    drop = np.zeros(n + 1, np.int64)
    np.add.at(drop, start + period, 1)
    np.add.at(drop, start + length, -1)
    kept = np.cumsum(drop[:-1]) == 0
    sizes = np.r_[0, np.cumsum(np.bincount(owner, kept, texts).astype(np.int64))].astype(np.int32)
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(sizes), every.filter(pa.array(kept))), " ")
    of = owner[start] if len(start) else np.zeros(0, np.int64)
    rows = pa.StructArray.from_arrays([pa.array(start - (upto - counts)[of]), pa.array(length), pa.array(period)], fields=list(_RUN_TYPE))
    return counts, pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(of, minlength=texts))].astype(np.int32)), rows), collapsed


def _searcher(min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, data, bounds in chunks(batch.column(1)):
                counts, found, collapsed = _search(data, bounds, min_length)
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(counts)), pa.array(counts.astype(np.int64)), found, collapsed], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = 12) -> DataFrame:
    """doc_id, n_words, runs and collapsed for every row of docs.

    runs: array of (start, length, period) by start, then period, in words counted from 0: longest stretches with that
    smallest period, of at least min_length (2 at least) words and two periods. collapsed: the words, joined by single
    spaces, less those that stand in a run after its first period.

    A null, empty or blank text has no words, no runs and an empty collapsed text. Whole texts are searched, each in one
    task, with about 20 log2(n) bytes for each of its n words if it has a repeated window. Ids may be null; repeated rows
    are searched one by one. An empty table gives no rows. Other columns are ignored.
    """
    if min_length < 2:
        raise ValueError("a run has two words at least")
    small_batches(docs.sparkSession)
    chosen = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(_searcher(min_length), f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")
