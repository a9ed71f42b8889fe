"""From raw documents to packed training sequences, in five stages over whole tables.

Toxic documents go; of near duplicates one stays; passages that an earlier document holds are cut; live secrets are
masked; what is left is packed. Each stage reads what its predecessor wrote to the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import packing, secret_scan, simhash, suffix_dedup, toxicity
from lodestar.llm.queries import vocabulary
from lodestar.llm.shared import table, written


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score as toxic. Null and blank texts are scored like others, and each of repeated rows or
    ids by its own text; without labels of both kinds nothing goes. All columns stay as they are."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingle sets of similarity 0.8 or more. The smallest id
    stays, a null id only in a group without others; of rows with that id, one. Blank and null texts are one group."""
    return simhash.keep_one(docs, size=5, least=0.8)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes or more that a document of a smaller id holds. Every row stays, a text may
    become empty, a null text stays null; a null id counts as the largest; rows of one id cut nothing from each other."""
    rest = F.struct(F.col("text").isNull().alias("none"), F.struct(*(docs[c] for c in docs.columns if c != "text")).alias("row"))
    cut = suffix_dedup.suffix_dedup(docs, extra=rest, kept_text=True)
    text = F.when(~F.col("extra")["none"], F.col("text")).alias("text")
    return _counted(cut.select(*(text if c == "text" else F.col("extra")["row"][c].alias(c) for c in docs.columns)))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with live secrets masked. Every row stays; spans belong to rows, so null and repeated ids are masked alike."""
    return _counted(secret_scan.redacted(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; a null or empty text has its closing id alone, repeated rows are packed each."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("passages", cut_passages),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Networks, components of near duplicates and tokens are beyond SQL; tests/llm/test_pipeline.py has a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
