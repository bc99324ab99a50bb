"""Vector columns: math in double over float arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

WORST = 2.0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - cosine; 2.0 for unlike lengths, empty vectors, null, or a norm of zero."""
    na, nb = norm_a if norm_a is not None else norm(a), norm_b if norm_b is not None else norm(b)
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (na > 0) & (nb > 0)
    return F.when(fits, 1 - dot(a, b) / (na * nb)).otherwise(F.lit(WORST))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector]).cast("array<double>")


def similarity(distance: Column) -> Column:
    return 1 / (1 + distance)


def distance_of_similarity(score: Column) -> Column:
    """The inverse, slightly low for the term that avoids a division by zero."""
    return 1 / (score + 1e-9) - 1


def to_bytes(vector: list[float]) -> bytes:
    return np.asarray(vector, "<f4").tobytes()


def from_bytes(raw: bytes) -> list[float]:
    """Little-endian floats; up to three bytes left over are ignored."""
    return np.frombuffer(raw[: len(raw) // 4 * 4], "<f4").tolist()
