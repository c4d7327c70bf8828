"""Line dedup with two Bloom filters.

Pass 1 fills, in every task, a once-seen and a twice-seen bitmap over the hashes of its lines' keys; bitmaps are
merged segment by segment, a bit being twice-seen if either side says so or both have it once. Pass 2 tests each
key against the merged twice-seen filter: a key in two documents always passes, few others do. Only these
suspects are shuffled, with their exact text, to confirm them and to choose the first document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from recordloom.llm import bloom
from recordloom.llm.work import materialize, small_batches

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _keys(text: str, least: int) -> set[bytes]:
    """Distinct keys of a text's lines that have at least `least` code points."""
    found = {line.strip(b" \t\n\x0b\x0c\r").lower() for line in text.encode().split(b"\n")}
    return {k for k in found if len(k) >= 4 * least or len(k) >= least and len(k.decode()) >= least}


def _hashed(keys: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))


def _hashes(least: int) -> bloom.Hashes:
    """Each key once for each text that has it."""
    return lambda batch: _hashed([k for text in batch.column(0).to_pylist() for k in _keys(text or "", least)])


def _suspects(filter_, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(filter_.value, np.uint8)
        for batch in batches:
            at, keys = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = _keys(text or "", least)
                keys.extend(own)
                at.extend([i] * len(own))
            if keys:
                chosen = np.flatnonzero(bloom.may_contain(twice, _hashed(keys)))
                docs = batch.column(0).take(pa.array(np.array(at, np.int64)[chosen]))
                yield pa.RecordBatch.from_arrays([docs, pa.array([keys[i].decode() for i in chosen], pa.string())], names=["doc", "key"])

    return run


def _without(text: str, drop: Sequence[str] | None) -> tuple[str, int, int]:
    """The text without lines whose key is in drop, the number of its lines and of those dropped."""
    lines = text.split("\n")
    if drop is None:
        return text, len(lines), 0
    gone = {k.encode() for k in drop}
    kept = [line for line in lines if line.encode().strip(b" \t\n\x0b\x0c\r").lower() not in gone]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


CUT = StructType([StructField("text", StringType()), StructField("lines", LongType()), StructField("dropped", LongType())])


@F.pandas_udf(CUT)
def _cut(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_without(t, d) for t, d in zip(texts, drops)], columns=["text", "lines", "dropped"])


def line_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 10,
    bits_per_line: int = 16,
    max_bits: int = 1 << 28,
) -> DataFrame:
    """Drops lines that another document has too, except in the document with the smallest id.

    Returns docs with the kept text in text_col, plus n_lines (before dropping) and n_dropped. A line's key is the
    line without white space at its ends, A-Z in lower case; keys under min_chars code points are left alone.
    The filter has bits_per_line bits for each line, at most max_bits (32 MB, broadcast): beyond that more keys
    are suspected and shuffled, and results stay exact.

    A null text is one empty line and comes back as the empty string; a text of any length is read whole, line by line
    in time in proportion to its length. Rows that repeat an id are one document. Rows without an id are documents of
    their own, after all others, in order of a hash of their text; equal texts among them are one document. A text that
    loses all its lines becomes empty and its row stays. An empty table gives an empty one. Columns named n_lines or
    n_dropped are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    number = F.col(f"`{id_col}`").cast("long")
    no_id = number.isNull()
    doc = F.struct(no_id.alias("no_id"), F.coalesce(number, F.lit(0)).alias("id"), F.when(no_id, F.xxhash64(text)).otherwise(0).alias("tag"))
    plain = docs.select(doc.alias("doc"), text.alias("text"))
    lines = plain.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits = bloom.bits_for(lines, bits_per_line, max_bits)
    filter_ = spark.sparkContext.broadcast(bloom.twice_seen(plain.select("text"), _hashes(min_chars), bits))
    suspects = materialize(plain.mapInArrow(_suspects(filter_, min_chars), f"doc {plain.schema['doc'].dataType.simpleString()}, key string"), "line-suspects")
    confirmed = suspects.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("final")).where("first < final").select("key", "first")
    mark = "_"
    while any(c.startswith(mark) for c in docs.columns):  # no column of docs may clash with those added here
        mark += "_"
    own, raw, other, drop, left = (mark + c for c in ("own", "text", "id", "drop", "kept"))
    drops = (
        suspects.join(materialize(confirmed, "line-repeats"), "key")
        .where("doc > first")
        .groupBy(F.col("doc").alias(other))
        .agg(F.collect_set("key").alias(drop))
    )
    named = docs.drop("n_lines", "n_dropped").withColumns({own: doc, raw: text})
    joined = named.join(drops, F.col(own) == F.col(other), "left").withColumn(left, _cut(F.col(raw), F.col(drop)))
    counted = joined.withColumns({"n_lines": F.col(left)["lines"], "n_dropped": F.col(left)["dropped"], text_col: F.col(left)["text"]})
    return counted.drop(own, raw, other, drop, left)
