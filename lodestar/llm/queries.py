"""Registered queries of this package: thin calls of its operators over whole tables, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive_search, best_fit, compression_quality, fill_in_middle, hard_negatives, packing, quality_rules, secret_scan, sentencepiece_codec, simhash, suffix_dedup, toxicity, wrappers
from .shared import table


def vocabulary(name: str) -> str:
    """Where an installed vocabulary file is, the same on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op2_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_quality.compression_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer or vocabulary("byte_bpe_50k.json"))


def op7_additive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_search.nearest(table(spark, sf_dir, "embeddings"), "id % 50 = 0")


def op8_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    return sentencepiece_codec.measured(table(spark, sf_dir, "documents"), model or vocabulary("piece_bpe_32k.model"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secret_scan(table(spark, sf_dir, "documents")))


def op11_pivot_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), "id % 100 = 0")


def op12_best_fit(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents"), tokenizer or vocabulary("word_bpe_49k.json"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_compression_quality": op2_compression_quality,
    "op3_wrappers": op3_wrappers,
    "op4_toxicity": op4_toxicity,
    "op5_simhash": op5_simhash,
    "op6_packing": op6_packing,
    "op7_additive_search": op7_additive_search,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_secret_scan": op10_secret_scan,
    "op11_pivot_negatives": op11_pivot_negatives,
    "op12_best_fit": op12_best_fit,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op11_pivot_negatives": hard_negatives.ORACLE,
    "op13_fill_in_middle": fill_in_middle.ORACLE,
}
