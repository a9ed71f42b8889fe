"""Golden cases against what a model gives now: one row for each check, and a report of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

RESULT = "kind string, id string, passed boolean, message string"


def _result(kind: str, passed: Column, message: Column) -> Column:
    ok = F.coalesce(passed, F.lit(False))
    return F.struct(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), ok.alias("passed"), F.when(~ok, message).alias("message"))


def _cosine_result(kind: str, own: str, golden: str, least: Column) -> Column:
    """A length that differs or a vector without direction fails, as does what is missing."""
    cos = V.cosine_or_minus_one(own, golden)
    return _result(kind, cos >= least, F.when(F.col(own).isNotNull(), F.format_string("cosine %.4f, at least %.4f", cos, least.cast("double"))).otherwise("nothing to compare"))


def _results(rows: DataFrame, *checks: Column) -> DataFrame:
    return rows.select(F.inline(F.array(*checks)))


def text_results(golden: DataFrame, own: DataFrame) -> DataFrame:
    """Of the text cases in golden documents, with own (id, own_token_ids, own_embedding): tokens, if they must match, and embeddings."""
    rows = golden.select("tolerances", F.inline("text_cases")).join(own, "id", "left")
    at = V.first_mismatch(F.col("token_ids"), F.col("own_token_ids"))
    same = F.when(F.coalesce(F.col("tolerances.token_ids_exact_match"), F.lit(True)), F.col("own_token_ids").isNotNull() & at.isNull()).otherwise(True)
    return _results(rows, _result("tokens", same, F.when(at.isNotNull(), F.format_string("token %d differs", at)).otherwise("no tokens")),
                    _cosine_result("text embedding", "own_embedding", "text_embedding", F.col("tolerances.text_embedding_cosine_min")))


def image_results(golden: DataFrame, own: DataFrame) -> DataFrame:
    """Of the image cases, with own (id, tensor, own_tensor, own_embedding): the prepared image, by cosine and the largest
    difference, where there is a tensor to compare with, and the embedding."""
    rows = golden.select("tolerances", F.inline("image_cases")).join(own, "id", "left")
    t = F.col("tolerances")
    cos, far = V.cosine_or_minus_one("own_tensor", "tensor"), V.max_abs_difference("own_tensor", "tensor")
    prepared = F.when(F.col("tensor").isNull(), True).otherwise((cos >= t["image_preprocess_cosine_min"]) & (far <= t["image_preprocess_abs_diff_max"]))
    return _results(rows, _result("image", prepared, F.when(F.col("own_tensor").isNotNull(), F.format_string("cosine %.4f, difference %.4f", cos, far)).otherwise("nothing to compare")),
                    _cosine_result("image embedding", "own_embedding", "image_embedding", t["image_embedding_cosine_min"]))


def similarity_results(cases: DataFrame) -> DataFrame:
    """Of cases (id, similarity, own, most: the largest difference allowed)."""
    far = F.abs(F.col("own").cast("double") - F.col("similarity").cast("double"))
    return _results(cases, _result("similarity", far <= F.col("most"), F.when(far.isNotNull(), F.format_string("differs by %.4f", far)).otherwise("nothing to compare")))


def report(results: DataFrame, most: int = 20) -> DataFrame:
    """(kind, passed, checks, failures, messages): the messages of the first `most` failures by id, joined; Spark finds these in
    each task before the shuffle. The failures themselves are rows of results."""
    sums = results.groupBy("kind").agg(F.bool_and("passed").alias("passed"), F.count(F.lit(1)).alias("checks"), F.count_if(~F.col("passed")).alias("failures"))
    first = results.where("not passed").withColumn("nth", F.row_number().over(Window.partitionBy("kind").orderBy("id"))).where(F.col("nth") <= most)
    told = first.groupBy("kind").agg(F.expr("listagg(concat(id, ': ', message), '; ') within group (order by nth)").alias("messages"))
    return sums.join(told, "kind", "left")
