"""Quality rules as a short-circuit cascade. DataFrame functions only.

Each rule's cost (seconds, net of what a job costs anyway) and selectivity (share of rows rejected) are measured on
the rows of a sample that the base lets through, as those are what the cascade sees; rules then run in order of
rejection per cost, and a row leaves the cascade at the first rule that rejects it: later rules are never evaluated for
it. The order changes the work, not the verdict.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.lines import BLANKS
from recordloom.llm.mixing import WORD
from recordloom.llm.work import materialize

SYMBOLS = "#*$%&|<>"
#: Evaluations that a rule is timed on.
TIMED_ROWS = 6000

#: Conditions under which a text is rejected, over the base counts and the text (never null here).
RULES: dict[str, str] = {
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * (length(text) - length(replace(text, '\n', '')) + 1)",
    "shouting": r"10 * regexp_count(text, '!!') > n_words",
    "capitals": r"length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) > length(text) / 2",
    "no_letters": r"5 * length(translate(text, '0123456789.,;:-+/()[]{}=_', '')) < 2 * length(text)",
    "endless_word": r"text rlike '[^\\x20\\x09-\\x0D]{1000}'",
}


def base_counts(text: Column) -> dict[str, Column]:
    """Counts that need the text alone; n_words and n_repeat_words come from the words' array, see with_base()."""
    blank_free = F.translate(text, BLANKS, "")
    full_lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "word_chars": F.length(blank_free).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": F.aggregate(F.array(full_lines), F.lit(0), lambda n, x: n + F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def _covered(at: Column) -> Column:
    """Words covered by 3-word windows that start at the ascending positions in `at`."""
    steps = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
    return F.aggregate(steps, F.lit(0), lambda total, n: total + n)


def with_base(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds text, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    Windows are compared by 64-bit hashes. A text without a repeat costs one pass; with few repeated windows,
    their places are looked up; with many, (hash, place) pairs are sorted, so that work stays n log n.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    worded = docs.withColumn("__text", text).withColumns(base_counts(F.col("__text")) | {"__words": F.regexp_extract_all("__text", F.lit(WORD), F.lit(0))})
    words = F.col("__words")
    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    hashed = worded.withColumns({"n_words": F.size(words).cast("long"), "__windows": windows})
    h = F.col("__windows")
    hashed = hashed.withColumn("__sorted", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(h)))
    s = F.col("__sorted")
    hashed = hashed.withColumn("__again", F.when(s.isNotNull(), F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1)))))
    few = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(F.col("__again"), x), i)), lambda i: i.isNotNull())
    hashed = hashed.withColumn("__pairs", F.when(F.size("__again") > 64, F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    p = F.col("__pairs")
    paired = F.filter(p, lambda x, i: (x["h"] == F.get(p, i - 1)["h"]) | (x["h"] == F.get(p, i + 1)["h"]))
    # beyond either end get() gives null, which only matters if the other side doesn't match
    many = F.sort_array(F.transform(paired, lambda x: x["i"]))
    hashed = hashed.withColumn("__at", F.when(s.isNull(), F.array().cast("array<int>")).when(p.isNull(), few).otherwise(many))
    counted = hashed.withColumn("n_repeat_words", _covered(F.col("__at")).cast("long"))
    return counted.drop("__words", "__windows", "__sorted", "__again", "__pairs", "__at")


def _base_failed(min_words: int) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measured(sample: DataFrame, rules: dict[str, str], timed_rows: int = TIMED_ROWS) -> list[tuple[str, float, float]]:
    """(rule, net seconds, share rejected) on a materialized sample.

    A rule runs in one task over the sample, repeated up to timed_rows rows; from the better of two runs goes what a
    rule takes that only looks at the text's length.
    """
    rows = sample.count()
    if not rows:
        return [(name, 1.0, 0.0) for name in rules]
    many = sample.coalesce(1).withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(-(-timed_rows // rows)))))

    def timed(rule: str) -> tuple[float, int]:
        job = many.agg(F.sum(F.expr(f"case when {rule} then 1 else 0 end")).alias("n"))
        took = []
        for _ in range(3):  # the first one compiles the code
            began = time.perf_counter()
            n = job.first()["n"]
            took.append(time.perf_counter() - began)
        return min(took[1:]), n

    nothing, _ = timed("octet_length(text) + n_words + n_symbols + word_chars + n_dup_lines < 0")
    found = [(name, *timed(rule)) for name, rule in rules.items()]
    return [(name, max(1e-4, seconds - nothing), n / (rows * -(-timed_rows // rows))) for name, seconds, n in found]


def order_rules(docs: DataFrame, rules: dict[str, str], text_col: str, min_words: int, sample_rows: int, seed: int) -> list[str]:
    """Rules by rejection per cost, best first; as given where that is equal, as without rows."""
    rows = docs.count()
    if not rows:
        return list(rules)
    sample = docs.select(F.col(f"`{text_col}`").alias("t")).sample(min(1.0, sample_rows / rows), seed)
    based = materialize(with_base(sample, "t").drop("t").withColumnRenamed("__text", "text"), "quality-sample")
    through = based.where(~_base_failed(min_words))  # on the table: pushed into the counts, the filter would repeat them
    return [name for name, seconds, share in sorted(measured(through, rules), key=lambda m: -m[2] / m[1])]


def quality_cascade(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: dict[str, str] | None = None,
    min_words: int = 50,
    sample_rows: int = 2000,
    seed: int = 7,
) -> DataFrame:
    """Judges every row; returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by.

    base_failed: fewer than min_words words, or more than half of the words stand in repeated 3-word windows.
    rejected_by: "base", else the first rule of the cascade that rejects the text, else null; kept: rejected_by is
    null. The sample only sets the order of rules: where several rules reject a text, rejected_by follows that order
    and so the timings; all else is the same in every run.

    Whole texts are read, whatever their length. A null or empty text has zero counts and fails the base. Words are never null, and ids may be. Repeated rows
    are judged one by one. An empty table gives no rows. Other columns are ignored.
    """
    rules = RULES if rules is None else rules
    order = order_rules(docs, rules, text_col, min_words, sample_rows, seed)
    chosen = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("t"))
    based = with_base(chosen, "t").drop("t").withColumnRenamed("__text", "text")
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for name in order:
        verdict = verdict.when(F.expr(rules[name]), F.lit(name))
    judged = based.withColumn("base_failed", _base_failed(min_words)).withColumn("rejected_by", verdict)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")
