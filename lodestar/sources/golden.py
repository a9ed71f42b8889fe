"""Files of golden cases: one JSON document with texts, images and the similarities of their pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of the format.
MODEL = "struct<id: string, image_size: int, context_length: int, embedding_dimension: int, image_mean: array<float>, image_std: array<float>>"
TOLERANCES = """struct<token_ids_exact_match: boolean, text_embedding_cosine_min: float, image_preprocess_cosine_min: float,
image_preprocess_abs_diff_max: float, image_embedding_cosine_min: float, similarity_abs_diff_max: float>"""
TEXT = "struct<id: string, text: string, token_ids: array<int>, text_embedding: array<float>>"
IMAGE = "struct<id: string, image: string, preprocessed_tensor_file: string, preprocessed_tensor_shape: array<int>, image_embedding: array<float>>"
PAIR = "struct<id: string, image_case_id: string, text_case_id: string, similarity: float>"
SCHEMA = f"""baseline_version string, generated_at string, generator struct<name: string, onnxruntime_version: string>, model {MODEL},
tolerances {TOLERANCES}, text_cases array<{TEXT}>, image_cases array<{IMAGE}>, similarity_cases array<{PAIR}>"""


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document at the path; fields that a document lacks are null, others are not read."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)


def cases(golden: DataFrame, kind: str) -> DataFrame:
    """The cases of a kind (text, image or similarity), a row each."""
    return golden.select(F.inline(f"{kind}_cases"))


def similarity_pairs(golden: DataFrame) -> DataFrame:
    """(id, similarity, image_embedding, text_embedding) of the pairs of which both sides are there."""
    text = cases(golden, "text").select(F.col("id").alias("text_case_id"), "text_embedding")
    image = cases(golden, "image").select(F.col("id").alias("image_case_id"), "image_embedding")
    return cases(golden, "similarity").join(text, "text_case_id").join(image, "image_case_id").select(
        "id", "similarity", "image_embedding", "text_embedding")
