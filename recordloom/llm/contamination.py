"""Benchmark passages in documents, found by winnowing.

Of every `window` consecutive words, the smallest hash among the grams of `gram` words is a fingerprint, the first of
equal ones. Which gram that is depends on the window's words alone, so a window that a document shares with an item
gives the same fingerprint on both sides: every shared span of `window` words or more is found. Fingerprints are joined,
and each hit is extended to the windows around it whose fingerprint it is; those must equal a window of an item word by word.

An item with fewer words is one window, whose fingerprint is the hash of all its words; documents give the hash of each of
their grams of that length, for the lengths that there are.

Everything is a DataFrame expression. Fingerprints of documents meet a broadcast table of slots first, which has SLOTS
rows at most whatever the benchmark's size; what is in no slot of an item is never shuffled.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.work import materialize, spread_join

#: Ends of words: ASCII characters but digits and lower-case letters.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Slots of fingerprints, the most rows that are broadcast.
SLOTS = 1 << 20
_LENGTH_SHIFT = 32


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, BREAKS), "")


def _joined(grams: Column, others: Column, step: int) -> Column:
    """Hashes of a gram at i and another one at i + step, for all i where both exist."""
    n = F.greatest(F.least(F.size(grams), F.size(others) - step), F.lit(0))
    return F.transform(F.slice(grams, 1, n), lambda g, i: F.xxhash64(g, F.get(others, i + step)))


def with_grams(worded: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds g<n>, the hashes of all grams of n words, for each of lengths, from the column words.

    Grams are put together from those of 1, 2, 4, ... words, one column at a time, so that none is computed twice.
    """
    df = worded.withColumn("g1", F.transform("words", lambda w: F.xxhash64(w)))
    made = {1}
    for n in sorted(lengths):
        whole = 1
        while 2 * whole <= n:
            if 2 * whole not in made:
                df = df.withColumn(f"g{2 * whole}", _joined(F.col(f"g{whole}"), F.col(f"g{whole}"), whole))
                made.add(2 * whole)
            whole *= 2
        rest = n - whole
        while whole < n:
            part = 1 << (rest.bit_length() - 1)
            if whole + part not in made:
                df = df.withColumn(f"g{whole + part}", _joined(F.col(f"g{whole}"), F.col(f"g{part}"), whole))
                made.add(whole + part)
            whole, rest = whole + part, rest - part
    return df.drop(*(f"g{n}" for n in made if n not in lengths))


def _chosen(grams: Column, at: Column, width: int) -> Column:
    """Where the smallest of the `width` grams from `at` on is, as a distance; the first of equal ones."""
    value = [F.get(grams, at + j) for j in range(width)]
    place = F.lit(width - 1)
    for j in range(width - 2, -1, -1):
        least = value[j] <= value[j + 1]
        for k in range(j + 2, width):
            least = least & (value[j] <= value[k])
        place = F.when(least, F.lit(j)).otherwise(place)
    return place


def _starts(n: Column, length: int) -> Column:
    """0, 1, ... up to the last window of `length` of n words; empty if there is none."""
    return F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int, gram: int) -> DataFrame:
    """(item_id string, window: words joined by spaces, length, fp), a row for each window of each item."""
    worded = items.select(F.col(f"`{id_col}`").cast("string").alias("item_id"), words_of(F.col(f"`{text_col}`")).alias("words")).where(F.size("words") > 0)
    n = F.size("words")
    hashed = with_grams(worded.withColumn("length", F.least(n, F.lit(window))), [*range(1, window), *([gram] if gram >= window else [])])
    placed = hashed.withColumn("at", F.explode(_starts(n, 1))).where((F.col("at") == 0) | (F.col("at") + window <= n))
    whole = F.coalesce(*(F.when(F.col("length") == m, F.get(f"g{m}", 0)) for m in range(1, window)))
    grams = F.col(f"g{gram}")
    chosen = F.get(grams, F.col("at") + _chosen(grams, F.col("at"), window - gram + 1))
    told = F.when(F.col("length") == window, chosen).otherwise(whole)
    text = F.array_join(F.slice("words", F.col("at") + 1, F.col("length")), " ")
    return placed.select("item_id", text.alias("window"), "length", F.xxhash64(told, F.col("length")).alias("fp"))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, slots: DataFrame, short: list[int], window: int, gram: int) -> DataFrame:
    """(doc_id, key, n_words, length, at, fp, nearby, nearby_from): a row with at = -1 for each document, and its fingerprints in slots.

    key names the text, nearby holds the words from nearby_from on of all windows that may have the fingerprint.
    """
    width = window - gram + 1
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit("\0"), text))
    worded = docs.select(F.col(f"`{id_col}`").alias("doc_id"), key.alias("key"), words_of(F.col(f"`{text_col}`")).alias("words"))
    hashed = with_grams(worded, sorted({gram, *short}))
    grams, n = F.col(f"g{gram}"), F.size("words")
    least = F.transform(F.slice(grams, 1, F.greatest(F.size(grams) - width + 1, F.lit(0))), lambda _, i: i + _chosen(grams, i, width))
    coded = lambda length, at: at.cast("array<bigint>") if not length else F.transform(at, lambda x: x.cast("bigint") + (length << _LENGTH_SHIFT))
    codes = [F.array(F.lit(-1).cast("bigint")), coded(0, F.array_distinct(least)), *(coded(m, _starts(n, m)) for m in short)]
    # never empty; explode() would ask for its size in a filter, and all that makes up codes would go there once more
    rows = hashed.withColumn("codes", F.concat(*codes)).withColumn("code", F.explode_outer("codes")).drop("codes")
    length = F.shiftright("code", _LENGTH_SHIFT).cast("int")
    at = F.when(F.col("code") >= 0, F.col("code").bitwiseAND((1 << _LENGTH_SHIFT) - 1).cast("int")).otherwise(-1)
    told = F.when(length == 0, F.get(grams, at))
    for m in short:
        told = told.when(length == m, F.get(f"g{m}", at))
    fp = F.when(F.col("code") >= 0, F.xxhash64(told, F.when(length == 0, F.lit(window)).otherwise(length)))
    rows = rows.withColumn("fp", fp).withColumn("slot", F.pmod("fp", F.lit(SLOTS)))
    found = rows.join(F.broadcast(slots.withColumn("in_slot", F.lit(True))), "slot", "left").where((F.col("code") < 0) | F.col("in_slot"))
    first = F.when(length == 0, F.greatest(at - (width - 1), F.lit(0))).otherwise(at)
    return found.select(
        "doc_id",
        "key",
        n.cast("long").alias("n_words"),
        F.when(length == 0, F.lit(window)).otherwise(length).alias("length"),
        at.alias("at"),
        "fp",
        F.when(F.col("code") >= 0, F.slice("words", first + 1, F.when(length == 0, F.lit(window + width - 1)).otherwise(length))).alias("nearby"),
        first.alias("nearby_from"),
    )


def extended(seeds: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, start, length, window): the windows of a document that may have a seed as their fingerprint."""
    back = F.when(F.col("length") == window, F.least(F.lit(window - gram), F.col("at"))).otherwise(0)
    starts = F.transform(F.sequence(F.lit(0), back), lambda o: F.col("at") - o)
    placed = seeds.withColumn("start", F.explode(starts)).where(F.col("start") + F.col("length") <= F.col("n_words"))
    text = F.array_join(F.slice("nearby", F.col("start") - F.col("nearby_from") + 1, F.col("length")), " ")
    return placed.select("key", "start", "length", text.alias("window"))


def hit_words(spans: Column) -> Column:
    """How many words the (start, end) spans cover, given in ascending order."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda acc, s: F.struct(F.greatest(acc["end"], s["end"]).alias("end"), (acc["n"] + F.greatest(s["end"] - F.greatest(acc["end"], s["start"]), F.lit(0))).alias("n"))
    return F.aggregate(spans, zero, step, lambda acc: acc["n"]).cast("long")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    gram: int = 8,
) -> DataFrame:
    """doc_id, n_words, spans, items for every row of docs.

    Words are runs of digits, letters a-z (A-Z counting as such) and non-ASCII characters. spans: ascending (start, end)
    of the windows of `window` words that an item has too, or of whole items with fewer words. items: ids of these
    items as strings, sorted.

    Whole texts are read. A null, empty or wordless text has no spans, and such an item no window. An item without an id
    still gives spans, but is not named; rows with one item id are one item. Ids of documents may be null, and repeated
    rows are judged one by one. An empty table on either side is no error. Other columns are ignored.

    A document's windows are gathered in one row, as its text is. Frequent fingerprints and windows are spread; documents
    with the same set of windows look their items up once.
    """
    if not 1 <= gram < window:
        raise ValueError("a gram has fewer words than a window")
    windows = materialize(item_windows(items, item_col, item_text_col, window, gram), "item-windows")
    short = sorted(r[0] for r in windows.where(f"length < {window}").select("length").distinct().collect())
    slots = materialize(windows.select(F.pmod("fp", F.lit(SLOTS)).alias("slot")).distinct(), "item-slots")
    rows = materialize(fingerprints(docs, id_col, text_col, slots, short, window, gram), "fingerprints")
    every, seeds = rows.where("at < 0"), rows.where("at >= 0")
    hits = spread_join(seeds, windows.select("fp").distinct(), "fp", "key")
    around = materialize(extended(hits, window, gram), "windows")
    known = windows.select("window").distinct().withColumn("window_id", F.md5("window"))
    shared = spread_join(around, known, "window", "key")
    span = F.struct("start", (F.col("start") + F.col("length")).alias("end"))
    by_text = shared.groupBy("key").agg(F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.collect_set("window_id")).alias("ids"))
    by_text = materialize(by_text.withColumn("set", F.sha2(F.array_join("ids", ","), 256)), "spans")
    sets = by_text.groupBy("set").agg(F.first("ids").alias("ids")).withColumn("window_id", F.explode("ids"))
    named = windows.select(F.md5("window").alias("window_id"), "item_id").distinct()
    items_of = sets.join(named, "window_id").groupBy("set").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    told = spread_join(by_text.select("key", "spans", "set"), items_of, "set", "key").drop("set")
    none = F.array().cast("array<struct<start:int,end:int>>"), F.array().cast("array<string>")
    joined = every.select("doc_id", "key", "n_words").join(told, "key", "left")
    return joined.select("doc_id", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))
