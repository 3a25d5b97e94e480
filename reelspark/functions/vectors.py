"""Vector functions over array columns; sums are made in double precision whatever the array holds."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import is_finite


def wide(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(wide(a), wide(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(wide(v), F.lit(0.0), lambda s, x: s + x * x))


def all_finite(v: Column) -> Column:
    return F.forall(v, lambda x: is_finite(x))


def any_nonzero(v: Column) -> Column:
    return F.exists(v, lambda x: x != 0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors that are known to be good: no check, null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine that fails on unequal lengths, components that aren't finite, and zero vectors; not clamped."""
    good = (F.size(a) == F.size(b)) & all_finite(a) & all_finite(b) & any_nonzero(a) & any_nonzero(b)
    return F.when(F.coalesce(good, F.lit(False)), dot(a, b) / (norm(a) * norm(b))).otherwise(F.raise_error(F.lit("vectors must be finite, not zero and equally long")).cast("double"))


def as_floats(v: Column, dimension: int) -> Column:
    """The vector as 32-bit floats; fails where its length isn't the dimension."""
    return F.when(F.size(v) == dimension, v.cast("array<float>")).otherwise(F.raise_error(F.lit(f"vector length must be {dimension}")).cast("array<float>"))


def check_query(vector: Sequence[float], dimension: int | None = None) -> list[float]:
    """A query vector as a list: finite, not zero, of the stated length."""
    own = [float(x) for x in vector]
    if not own or (dimension is not None and len(own) != dimension):
        raise ValueError("query vector has the wrong length")
    if not all(map(math.isfinite, own)):
        raise ValueError("query vector must be finite")
    if not any(own):
        raise ValueError("query vector must not be zero")
    return own


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])
