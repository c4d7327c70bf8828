"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

A document is expected in the mix so many times: its source's level times its own weight, max_repeat at most. The
level is the one at which the source meets its target in words. The whole part of the expectation gives certain
copies; the rest is the probability of one more, and differs between documents. These are drawn by Pareto order
sampling without replacement, of a size fixed in words: documents are ranked by their random odds divided by the odds
of their inclusion, and taken in that order up to the number of words left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.work import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Bins of the ranks' logarithm. A bin holds about 1/4096 of a source at most.
BINS_PER_UNIT = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def length_weight(size: Column) -> Column:
    """The default weight: binary digits of the number of words, so that a long document is likelier than a short one."""
    return F.length(F.bin(size)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the key and the seed alone, so that reruns agree."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), key)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_plan(sizes: DataFrame, cycle: tuple[int, ...], max_repeat: int) -> DataFrame:
    """From (source_key, source, source_size): target, and its words as a whole number.

    Targets are min(max_repeat * size, level * weight) with the level at which they use all words. Sources are
    sorted by the level at which they hit their limit. With all before a source at their limits, the level rises as
    long as that is true of them and falls after that, so it is the highest of these. One row per source.
    """
    everything = Window.orderBy(F.col("source").isNull(), "source")
    weights = [F.lit(w) for w in cycle]
    nth = F.row_number().over(everything)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*weights), ((nth - 1) % len(cycle) + 1).cast("int")).cast("long"))
    whole_input = Window.partitionBy()
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "source_key").rowsBetween(Window.unboundedPreceding, -1)
    limited = weighed.withColumn("limit", F.col("source_size") * max_repeat)
    ranked = limited.withColumns(
        {
            "level": (F.sum("source_size").over(whole_input) - F.coalesce(F.sum("limit").over(by_limit), F.lit(0)))
            / (F.sum("weight").over(whole_input) - F.coalesce(F.sum("weight").over(by_limit), F.lit(0))).cast("double")
        }
    )
    levelled = ranked.withColumn("level", F.max("level").over(whole_input))
    target = F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight"))
    sized = levelled.withColumn("target", F.when(F.col("source_size") > 0, target).otherwise(F.lit(0.0)))
    return sized.select("source_key", "source_size", "target", F.rint("target").cast("long").alias("words"))


def source_levels(classes: DataFrame, max_repeat: int) -> DataFrame:
    """From (source_key, weight, size: words of the class, words: the source's in the mix) to the level of each source.

    Classes of documents of one weight, heaviest first, hit max_repeat in that order; as above, the level is the
    highest that any number of classes at their limit gives. A source has as many classes as weights.
    """
    heavier = Window.partitionBy("source_key").orderBy(F.desc("weight")).rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("source_key")
    full, loose = F.coalesce(F.sum("size").over(heavier), F.lit(0)), F.col("size") * F.col("weight")
    rest = F.sum(loose).over(own) - F.coalesce(F.sum(loose).over(heavier), F.lit(0))
    each = classes.where("size > 0").withColumn("level", (F.col("words") - full * max_repeat).cast("double") / rest.cast("double"))
    return each.groupBy("source_key").agg(F.max("level").alias("level"))


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cycle: tuple[int, ...] = (1, 2, 3),
    max_repeat: int = 3,
    weight: Callable[[Column], Column] = length_weight,
    seed: str = "mix:",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """How often each document enters the mix; one row per input row.

    Columns: doc_id, source, size (words), source_size, target (the source's words in the mix), taken (words
    taken, repeats counted) and copies (taken / size, rounded); with carry, also a struct `carried` of those columns
    of docs. Sources in code-point order, null last, weigh as in cycle, repeating; targets share the words of all
    documents and stop at max_repeat times the source. weight: a positive whole number for each document, from its
    size; within a source, expected copies are in proportion to it, up to max_repeat. The document at the edge of a
    sample is taken in part, so a source's taken words equal its target to the word.

    A null or empty text has size 0 and is taken 0 times. Null sources are one source. Ties of the rank go by id, then
    size. Draws depend on the id; documents without one draw by their text. Repeated rows are documents of their own
    with one draw, so they stand together. An empty table gives no rows; other columns are ignored.

    Texts are read and never shuffled: a document's fate follows from its own numbers and those of its source, but
    for documents whose rank is in the same bin as the edge of the sample, about one in 4096.
    """
    doc_id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))
    chosen = docs.select(
        doc_id.alias("doc_id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        word_count(text).alias("size"),
        uniform(key, seed).alias("draw"),
        *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []),
    )
    named = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source"))
    keyed = chosen.withColumns({"source_key": named, "weight": weight(F.col("size"))})
    slim = materialize(keyed.drop("carried"), "mix-sizes")
    classes = slim.groupBy("source_key", "weight").agg(F.first("source").alias("source"), F.sum("size").alias("size"))
    classes = materialize(classes, "mix-classes")
    sizes = classes.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    plan = materialize(source_plan(sizes, cycle, max_repeat), "mix-plan")
    levels = source_levels(classes.join(plan, "source_key").select("source_key", "weight", "size", "words"), max_repeat)
    plan = plan.join(levels, "source_key", "left").withColumn("level", F.coalesce("level", F.lit(0.0)))
    expected = F.least(F.lit(float(max_repeat)), F.col("level") * F.col("weight"))
    certain = classes.join(plan, "source_key").groupBy("source_key").agg(F.sum(F.floor(expected) * F.col("size")).alias("certain"))
    plan = materialize(plan.join(certain, "source_key").withColumn("rest", F.col("words") - F.col("certain")).drop("words", "certain"), "mix-levels")

    def ranked(df: DataFrame) -> DataFrame:
        """With whole (certain copies), and rank and bin for documents that may be drawn once more."""
        joined = df.join(plan, "source_key").withColumn("whole", F.floor(expected)).withColumn("share", expected - F.col("whole"))
        odds = (F.col("draw") / (1 - F.col("draw"))) / (F.col("share") / (1 - F.col("share")))
        placed = joined.withColumn("rank", F.when((F.col("share") > 0) & (F.col("size") > 0), odds))
        limits = F.least(F.greatest(F.log("rank"), F.lit(-30.0)), F.lit(30.0))  # these skip nulls
        return placed.withColumn("bin", F.when(F.col("rank").isNotNull(), F.floor(limits * BINS_PER_UNIT).cast("int")))

    running = Window.partitionBy("source_key").orderBy("bin")
    bins = ranked(slim).where("bin is not null and rest > 0").groupBy("source_key", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    before = F.sum("words").over(running) - F.col("words")
    edges = bins.withColumn("before", before).where("before < rest and before + words >= rest").groupBy("source_key").agg(F.min("bin").alias("edge"), F.min("before").alias("before"))
    placed = ranked(keyed if carry else slim).join(materialize(edges, "mix-edges"), "source_key", "left")

    sure = placed.where("edge is null or bin is null or bin <> edge").withColumn("extra", F.when(F.col("bin") < F.col("edge"), F.col("size")).otherwise(F.lit(0)))
    in_order = Window.partitionBy("source_key").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(in_order), F.lit(0))
    at_edge = placed.where("bin = edge").withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), left)))
    taken = (F.col("whole") * F.col("size") + F.col("extra")).cast("long")
    copies = F.when(F.col("size") > 0, F.rint(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("long")
    more = ["carried"] if carry else []
    return sure.unionByName(at_edge).withColumn("taken", taken).select("doc_id", "source", "size", "source_size", "target", "taken", copies.alias("copies"), *more)
