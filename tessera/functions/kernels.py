"""Distances between array columns, summed in double precision.

Arrays must be of one length: check dimensions first. A NaN component makes the
result NaN. Spark orders NaN above all numbers, so a NaN is passed on before any
clamp is tried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Squared norms below this count as zero; a fixed value of the distance's definition.
ZERO_NORM2 = 1e-10


def vector_literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def _total(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_norm(v: Column) -> Column:
    return _total(F.transform(v, lambda x: x.cast("double") * x.cast("double")))


def l2_distance(a: Column, b: Column) -> Column:
    def square(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return F.sqrt(_total(F.zip_with(a, b, square)))


def cosine_from_parts(product: Column, norm2_a: Column, norm2_b: Column) -> Column:
    """Cosine distance from a dot product and the squared norms, which may be kept."""
    c = product / F.sqrt(norm2_a * norm2_b)
    return (
        F.when((norm2_a < ZERO_NORM2) | (norm2_b < ZERO_NORM2), F.lit(1.0))
        .when(F.isnan(c), F.lit(float("nan")))
        .when(c > 1, F.lit(0.0))
        .when(c < -1, F.lit(2.0))
        .otherwise(1 - c)
    )


def cosine_distance(a: Column, b: Column) -> Column:
    return cosine_from_parts(dot(a, b), squared_norm(a), squared_norm(b))


def normalize(v: Column) -> Column:
    """The vector at length one; a vector that counts as zero stays as it is."""
    n2 = squared_norm(v)
    scaled = F.transform(v, lambda x: x.cast("double") / F.sqrt(n2))
    return F.when(n2 < ZERO_NORM2, F.transform(v, lambda x: x.cast("double"))).otherwise(scaled)


def score(metric: str, a: Column, b: Column) -> Column:
    """What searches rank by: 1 - cosine distance, the dot product, or the distance."""
    if metric == "cosine":
        return 1 - cosine_distance(a, b)
    return dot(a, b) if metric == "dot" else l2_distance(a, b)


def ascending(metric: str) -> bool:
    """Whether smaller scores are closer."""
    return metric == "l2"


def quantize_int8(v: Column, scale: float = 127.0) -> Column:
    """Components in [-1, 1] as bytes; outside they are clamped."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.round(x.cast("double") * scale))).cast("byte"))


def dequantize_int8(v: Column, scale: float = 127.0) -> Column:
    return F.transform(v, lambda x: x.cast("double") / scale)
