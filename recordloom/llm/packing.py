"""Hierarchical multi-length packing of token sequences.

Documents are tokenized and cut into windows whose lengths are powers of two. A document first fills whole
windows of the longest tier; what remains is routed to the shortest tier that holds it. Tiers are packed from
the longest down; a window's gap takes the longest remainder of a shorter tier that fits, and the last few
tokens of the gap are cut from the shortest remainder left. So every window is full: the last one of a pool is
cut at powers of two, and no sequence carries padding.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.work import materialize, small_batches

#: Pre-tokenization pattern of byte-level BPE. Fixed value of the tokenizer's format.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space of that pattern; longer runs than the tokenizer's regular expression should see are cut out before it.
#: Fixed value: the characters with the Unicode property White_Space.
LONG_RUN = 4096
BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "window long, step_group long"
)
#: Rows as tasks pack them, before sequences are numbered across partitions.
PLACED = SCHEMA.replace("step_group", "nth")
#: Low bits of a sequence_id that number the sequences of a partition.
PARTITION_BITS = 40
#: Remainders that are packed together; bounds a task's memory at POOL * 4 KB of ids.
POOL = 4096
#: Words whose ids a worker remembers.
REMEMBERED = 400_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_of(symbols: str, table: dict[str, int]) -> bytes:
    return bytes(table[c] for c in symbols)


def _symbol_table() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others as code points from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


class Encoder:
    """Ids of a byte-level BPE tokenizer file, as little-endian 32-bit words.

    The vocabulary is read from the tokenizers JSON file; merging runs in tiktoken, which gives the same ids
    several times faster (tests compare the two), and ids of words seen before come from a bounded memory.
    With added, strings of the file's added tokens in a text become their ids, as tokenizers does by default, and
    what lies between them is encoded by itself; otherwise they are ordinary text (its encode_special_tokens).
    """

    def __init__(self, path: str, added: bool = False):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        table, special = _symbol_table(), {t["content"] for t in spec["added_tokens"]}
        ranks = {_bytes_of(s, table): i for s, i in spec["model"]["vocab"].items() if s not in special}
        self._plain = tiktoken.Encoding("plain", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self._memory: dict[str, bytes] = {}
        self._added = {t["content"]: array("I", [t["id"]]).tobytes() for t in spec["added_tokens"]} if added else {}
        if added and any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take white space or whole words only are not supported")
        longest_first = sorted(self._added, key=len, reverse=True)
        self._split = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")").split

    def _ids(self, text: str) -> bytes:
        """A long run of white space is a piece by itself, less its last character if more text follows.

        The pattern would try every end of the run in turn, on a stack that a million characters overflow.
        """
        if len(text) < LONG_RUN:
            return array("I", self._plain.encode_ordinary(text)).tobytes()
        ids, at = array("I"), 0
        for run in BLANKS.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            ids.extend(self._plain.encode_ordinary(text[at : run.start()]))
            ids.extend(self._plain._encode_single_piece(text[run.start() : end]))
            at = end
        ids.extend(self._plain.encode_ordinary(text[at:]))
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self._added):
            return b"".join(self._added[t] if t in self._added else self._words(t) for t in self._split(text) if t)
        return self._words(text)

    def _words(self, text: str) -> bytes:
        """A space between two visible characters always starts a piece, so words are encoded one by one."""
        words = text.split(" ")
        if "" in words or len(words) < 8:  # leading, trailing or repeated spaces: whole text at once
            return self._ids(text)
        memory = self._memory
        try:
            rest = b"".join(map(memory.__getitem__, words[1:]))
        except KeyError:
            if len(memory) > REMEMBERED:
                memory.clear()
            for w in words[1:]:
                if w not in memory:
                    if w[0].isspace() or w[-1].isspace():  # white space next to the space: it isn't a boundary
                        return self._ids(text)
                    memory[w] = self._ids(" " + w)
            rest = b"".join(map(memory.__getitem__, words[1:]))
        if words[0][-1].isspace():
            return self._ids(text)
        return self._ids(words[0]) + rest


def _fill(pool: list[tuple[int, int]]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """Windows as (length, [(key, skip, take)]) from remainders (length, key), skip being ids already taken."""
    pool.sort()
    skipped: dict[int, int] = {}

    def take(key: int, n: int, left: int) -> tuple[int, int, int]:
        at = skipped.get(key, 0)
        if left:
            skipped[key] = at + n
        return key, at, n

    while pool:
        n, key = pool.pop()
        window = 1 << (n - 1).bit_length()
        parts, gap = [take(key, n, 0)], window - n
        while gap and pool:
            at = bisect_right(pool, (gap, 1 << 62)) - 1
            if at >= 0:
                m, other = pool.pop(at)
                parts.append(take(other, m, 0))
                gap -= m
            else:
                m, other = pool.pop(0)
                parts.append(take(other, gap, m - gap))
                insort(pool, (m - gap, other))
                gap = 0
        if not gap:
            yield window, parts
            continue
        left = window - gap  # nothing is left to fill it: cut at powers of two
        while left:
            size = 1 << (left.bit_length() - 1)
            cut, need = [], size
            while need:
                key, at, m = parts[0]
                k = min(m, need)
                cut.append((key, at, k))
                need -= k
                parts[0:1] = [(key, at + k, m - k)] if m > k else []
            yield size, cut
            left -= size


def _packer(tokenizer: str | None, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer or default_tokenizer(), added=True)
        base = TaskContext.get().partitionId() << PARTITION_BITS
        n_seq, per_tier = 0, {}
        names = [c.split()[0] for c in PLACED.split(", ")]
        kept: dict[int, tuple] = {}
        pool: list[tuple[int, int]] = []
        rows: list[tuple] = []

        def sequence(window: int) -> tuple[int, int]:
            """Id of a new sequence, and its number among those of its tier in this partition."""
            nonlocal n_seq
            n_seq += 1
            per_tier[window] = per_tier.get(window, -1) + 1
            return base + n_seq - 1, per_tier[window]

        def packed() -> None:
            for window, parts in _fill(pool):
                seq, nth = sequence(window)
                at = 0
                for key, skip, n in parts:
                    doc, start, total, ids = kept[key]
                    rows.append((doc, start + skip, n, zlib.crc32(ids[4 * skip : 4 * (skip + n)]), total, seq, at, window, nth))
                    at += n
            kept.clear()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)
            rows.clear()
            return batch

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.encode(text or "") + b"\0\0\0\0"
                total = len(ids) // 4
                whole = total // longest * longest
                for start in range(0, whole, longest):
                    seq, nth = sequence(longest)
                    rows.append((doc, start, longest, zlib.crc32(ids[4 * start : 4 * (start + longest)]), total, seq, 0, longest, nth))
                if total > whole:
                    kept[len(kept)] = (doc, whole, total, ids[4 * whole :])
                    pool.append((total - whole, len(kept) - 1))
                    if len(pool) >= POOL:
                        packed()
                if len(rows) >= 5000:
                    yield out()
        packed()
        if rows:
            yield out()

    return run


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    longest: int = 1024,
    step_tokens: int = 65536,
) -> DataFrame:
    """Packs documents into sequences; returns one row per piece.

    tokenizer: path of a byte-level BPE file of the tokenizers library (default: the public 50k one), readable
    on every executor. longest: the longest window, a power of two. Columns: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, window (the sequence's length) and step_group: sequences of one tier that
    make up step_tokens tokens together, so that each step of training has the same shape and cost; only a tier's last
    group may have fewer.

    Each input partition is packed by itself: texts and ids are never shuffled, and a lost task is simply run again.
    Groups follow from the number of sequences of each tier in the partitions before. A null text counts as empty; an
    empty text is the single id 0; a text of any length is read whole. A null id stays null. Repeated rows are packed
    again. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    if longest < 1 or longest & (longest - 1) or step_tokens % longest:
        raise ValueError("longest must be a power of two, and step_tokens a multiple of it")
    small_batches(docs.sparkSession)
    chosen = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    placed = materialize(chosen.mapInArrow(_packer(tokenizer, longest), PLACED), "packed")
    placed = placed.withColumn("part", F.shiftright("sequence_id", PARTITION_BITS))
    counts = placed.groupBy("window", "part").agg((F.max("nth") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("window").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = placed.join(counts.select("window", "part", before.alias("before")), ["window", "part"])
    tier = F.length(F.bin("window"))  # tiers' groups differ in the low bits
    group = F.shiftleft(((F.col("before") + F.col("nth")) * F.col("window") / F.lit(step_tokens)).cast("long"), 6) + tier
    return joined.withColumn("step_group", group.cast("long")).select(*[c.split()[0] for c in SCHEMA.split(", ")])
