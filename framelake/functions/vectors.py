"""Vector arithmetic on ``ARRAY<DOUBLE>`` columns, in element order and double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    """L2 norm."""
    return F.sqrt(_total(F.transform(a, lambda x: x * x)))


def cosine_similarity(a: Column, b: Column) -> Column:
    """dot / (|a| |b|); 0 when either vector is all zero."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0.0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(scale, F.lit(0.0)))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan_distance(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def mean_pool(tokens: Column) -> Column:
    """Element-wise mean of an array of equally long vectors."""
    return F.transform(
        F.sequence(F.lit(0), F.size(tokens[0]) - 1),
        lambda d: _total(F.transform(tokens, lambda t: t[d])) / F.size(tokens),
    )


def l2_normalize(vec: Column) -> Column:
    """Divide by the L2 norm; an all-zero vector stays zero."""
    # the one-element array binds the norm once, so it is not recomputed per element
    return F.transform(
        F.array(norm(vec)),
        lambda length: F.when(length == 0.0, vec).otherwise(
            F.transform(vec, lambda x: x / F.nullif(length, F.lit(0.0)))
        ),
    )[0]
