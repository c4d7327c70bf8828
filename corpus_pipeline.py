"""The corpus pipeline: documents to packed training sequences, in five stages.

Stages share these rules. Any column may hold nulls. Empty and very long texts are documents like others and are read
whole. Rows that repeat an id are one document where documents are compared, and stay or go together. Columns besides
those of documents are left out, so their names can't clash. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import lines, mixing, neardup, packing, toxicity
from recordloom.llm.work import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grades reject go; the model is trained on the labelled documents among docs.

    Without labelled toxic documents all stay. A null or empty text has no words and stays. A document without an id
    is judged as well, by its text alone, and equal texts are judged alike.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs.select(COLUMNS), model)


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that another document has too stay in the first of them only; n_chars is that of the text left.

    A document that loses all its lines stays as an empty one, which the mix then takes no time. A null text becomes
    empty. Documents without an id come after all others and are documents of their own, in order of a hash of their text.
    """
    kept = lines.line_dedup(docs.select(COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8), the smallest id stays.

    Null and empty texts have no copies and stay, as do documents without an id, which can't be named as a copy.
    """
    dropped = neardup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.select(COLUMNS).join(dropped, "doc_id", "left_anti").select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: up to three rows, or none.

    The document at the edge of a sample is taken if at least half of it is. Texts without words (null, empty, blank)
    are never taken. A null source is a source of its own. Repeated rows are documents of their own here.
    """
    mix = mixing.mix_sources(docs, carry=tuple(COLUMNS)).where("copies > 0")
    return mix.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("carried.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of up to 1024, see packing.pack(); a null text counts as empty, an empty one is one id."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("line dedup", lines_once),
    ("near-dedup", near_copies_out),
    ("mixing", mixed),
    ("packing", packed),
]
ORACLE_SQL = None  # SQL can't express training, near-duplicate search and tokenization


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{at}")
    return docs
