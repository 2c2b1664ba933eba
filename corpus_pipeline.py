"""A training corpus from documents: five operators in a row.

Each stage works on all that its predecessor kept; all but the last return the columns of documents.
`run` writes each stage's rows to the shared folder, as Parquet, and reads them for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.packing import pack
from folioframe.llm.quality_classifier import keep_good
from folioframe.llm.quality_rules import keep_fit
from folioframe.llm.queries import vocabulary
from folioframe.llm.scratch import Scratch
from folioframe.llm.simhash_dedup import keep_one
from folioframe.llm.suffix_dedup import remove_repeats


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def check_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, with thresholds from those that came."""
    return keep_fit(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or 400 bytes that occur elsewhere; n_chars is counted anew where text went.

    Passages are found by strings of 200 bytes, which 50 words have wherever these have three letters on average.
    """
    out = remove_repeats(docs, length=200, width=128, words=50, size=400)
    if "n_chars" not in out.columns:
        return out
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", classify),
    ("quality rules", check_rules),
    ("simhash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack_sequences),
]

#: The first stage is a trained network, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
        scratch.release()
    return STAGES[-1][1](spark, docs, sf_dir)
