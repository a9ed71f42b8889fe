import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions import vectors as V

NUMBERS = st.lists(st.floats(-100, 100, allow_nan=False, width=32), min_size=1, max_size=6)


def one(spark, value, *rows, schema="a array<double>, b array<double>"):
    return [r[0] for r in spark.createDataFrame(list(rows), schema).select(value).collect()]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [([1.0, 0.0], [0.5, 0.5]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([], [])]
    got = one(spark, V.cosine("a", "b"), *rows)
    assert math.isclose(got[0], math.sqrt(0.5)) and got[1:] == [0, 0, 0]
    assert one(spark, V.euclidean("a", "b"), *rows)[2] == inf
    assert one(spark, V.max_abs_difference("a", "b"), *rows)[:3] == [0.5, 1.0, pytest.approx(3.4028234663852886e38)]
    with pytest.raises(Exception, match="different lengths"):
        one(spark, V.dot("a", "b"), rows[2])
    for r in rows[1:]:
        with pytest.raises(Exception, match="no cosine"):
            one(spark, V.cosine_strict("a", "b"), r)
    assert one(spark, V.is_valid("a"), ([1.0], []), ([], []), (None, []), ([nan], []), ([inf], []), ([None], [])) == [True] + [False] * 5
    assert one(spark, V.normalize("a"), ([3.0, 4.0], []), ([0.0, 0.0], []), ([1.0005, 0.0], [])) == [[0.6, 0.8], [0.0, 0.0], [1.0005, 0.0]]
    assert one(spark, V.is_normalized("a"), ([1.0009], []), ([1.0011], [])) == [True, False]


def test_mismatch(spark):
    rows = [([1, 2, 3], [1, 2, 3]), ([1, 2, 3], [1, 5, 3]), ([1, 2], [1, 2, 3]), ([], [1]), ([], [])]
    assert one(spark, V.first_mismatch(F.col("a"), F.col("b")), *rows, schema="a array<int>, b array<int>") == [None, 1, 2, 0, None]


def test_bands_and_scores(spark):
    got = one(spark, V.band(F.col("a")), (0.8,), (0.79,), (0.6,), (0.4,), (0.2,), (0.19,), schema="a double")
    assert got == ["very similar", "similar", "similar", "somewhat similar", "slightly similar", "not similar"]
    got = [round(x, 4) for x in one(spark, V.image_image_score(F.col("a")), (1.0,), (0.5,), (0.0,), schema="a double")]
    assert got == [0.9959, 0.9707, 0.8176]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(NUMBERS, NUMBERS), min_size=1, max_size=20))
def test_properties(spark, pairs):
    pairs = [(a[:n], b[:n]) for a, b in pairs for n in [min(len(a), len(b))]]
    df = spark.createDataFrame(pairs, "a array<double>, b array<double>")
    for (a, b), r in zip(pairs, df.select(V.cosine("a", "b"), V.cosine("b", "a"), V.l2_norm("a"), V.l2_norm(V.normalize("a"))).collect()):
        assert r[0] == pytest.approx(r[1]) and -1 - 1e-9 <= r[0] <= 1 + 1e-9 and r[2] == pytest.approx(float(np.linalg.norm(a)))
        assert r[3] == pytest.approx(1, abs=1e-3) or r[2] == 0


def test_validation_cosine(spark):
    assert one(spark, V.cosine_or_minus_one("a", "b"), ([1.0], [2.0]), ([0.0], [1.0]), ([], []), ([1.0], [1.0, 2.0])) == [1.0, -1.0, -1.0, -1.0]
