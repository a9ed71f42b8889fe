"""Vector arithmetic and score functions as column expressions. Sums run in double precision, in order of position."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tolerance of unit length, score bands and the scales and biases of the two logistic scores.
UNIT_TOLERANCE = 0.001
BANDS = ((0.8, "very similar"), (0.6, "similar"), (0.4, "somewhat similar"), (0.2, "slightly similar"))
LOWEST_BAND = "not similar"
TEXT_IMAGE_SCALE, TEXT_IMAGE_BIAS = 98.864479, -10.0
IMAGE_IMAGE_SCALE, IMAGE_IMAGE_BIAS = 4.0, 1.5


def _d(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product; vectors of different lengths are an error."""
    a, b = _d(a), _d(b)
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), F.raise_error("vectors of different lengths").cast("double")).otherwise(total)


def _plain_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column | str) -> Column:
    v = _d(v)
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Full cosine; 0 for different lengths, empty or zero vectors."""
    a, b = _d(a), _d(b)
    size = l2_norm(a) * l2_norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0), _plain_dot(a, b) / size).otherwise(F.lit(0.0))


def cosine_strict(a: Column | str, b: Column | str) -> Column:
    """As cosine(), but what it gives 0 for is an error."""
    a, b = _d(a), _d(b)
    fine = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (l2_norm(a) * l2_norm(b) > 0)
    return F.when(fine, cosine(a, b)).otherwise(F.raise_error("no cosine of these vectors").cast("double"))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    return 1 - cosine(a, b)


def euclidean(a: Column | str, b: Column | str) -> Column:
    """Distance; infinite for different lengths."""
    a, b = _d(a), _d(b)
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.sqrt(total)).otherwise(F.lit(float("inf")))


def is_normalized(v: Column | str) -> Column:
    return F.abs(l2_norm(v) - 1) < UNIT_TOLERANCE


def normalize(v: Column | str) -> Column:
    """Unit length; vectors of nearly unit length and zero vectors stay as they are."""
    v = _d(v)
    n = l2_norm(v)
    return F.when(is_normalized(v) | (n == 0), v).otherwise(F.transform(v, lambda x: x / n))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def text_image_score(cos: Column) -> Column:
    return 1 / (1 + F.exp(-(TEXT_IMAGE_SCALE * cos + TEXT_IMAGE_BIAS)))


def image_image_score(cos: Column) -> Column:
    return 1 / (1 + F.exp(-(IMAGE_IMAGE_SCALE * cos + IMAGE_IMAGE_BIAS)))


def band(score: Column) -> Column:
    out = F.when(score >= BANDS[0][0], BANDS[0][1])
    for low, name in BANDS[1:]:
        out = out.when(score >= low, name)
    return out.otherwise(LOWEST_BAND)


def percent(score: Column) -> Column:
    return F.format_string("%.0f%%", score * 100)


def max_abs_difference(a: Column | str, b: Column | str) -> Column:
    """Largest difference of components; the largest float for different lengths."""
    a, b = _d(a), _d(b)
    return F.when(F.size(a) == F.size(b), F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))).otherwise(F.lit(3.4028234663852886e38))


def first_mismatch(a: Column, b: Column) -> Column:
    """0-based place of the first difference; the shorter length if one array begins with the other; null if equal."""
    n = F.least(F.size(a), F.size(b))
    at = F.array_position(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x != y), True)
    return F.when(at > 0, at.cast("int") - 1).when(F.size(a) != F.size(b), n)


def is_valid(v: Column | str) -> Column:
    """Not null or empty, and all components finite."""
    v = _d(v)
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def cosine_or_minus_one(a: Column | str, b: Column | str) -> Column:
    """The cosine of a validation: -1 for what has none; norms must exceed the smallest step from 1."""
    a, b = _d(a), _d(b)
    fine = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (F.least(l2_norm(a), l2_norm(b)) > 2.220446049250313e-16)
    return F.when(fine, cosine(a, b)).otherwise(F.lit(-1.0))


def image_tensor(pixels: Column, mean: list[float], std: list[float]) -> Column:
    """Interleaved bytes (an array of whole numbers, one channel after another for each pixel) to planes of normalised
    numbers: byte / 255, less the channel's mean, over its deviation."""
    n = len(mean)
    plane = lambda c: F.transform(F.filter(pixels, lambda _, i: i % n == c), lambda x: (x / 255 - mean[c]) / std[c])
    return F.concat(*(plane(c) for c in range(n)))
