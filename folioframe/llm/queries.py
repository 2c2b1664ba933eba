"""The queries of this subpackage's operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, quality_rules


def vocabulary(name: str) -> str:
    """A public tokenizer's file; every operator takes such a path as a parameter."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_scan

    return license_scan(_documents(spark, sf_dir)).drop("spans")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_dedup import simhash_components

    return simhash_components(_documents(spark, sf_dir))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import quality_classifier

    return quality_classifier(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeat_digest

    return repeat_digest(_documents(spark, sf_dir))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import token_output

    return token_output(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_codec import round_trip

    return round_trip(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_license_scan, op3_quality_rules, op4_packing, op5_simhash_dedup, op6_quality_classifier, op7_suffix_dedup, op8_token_output, op9_embedding_dedup, op10_bpe_codec)
}
ORACLES: dict[str, str] = {"op3_quality_rules": quality_rules.ORACLE_SQL, "op9_embedding_dedup": embedding_dedup.ORACLE_SQL}
