"""Vector column expressions (arrays of doubles)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sql_dot(a: Column | str, b: Column | str) -> Column:
    """Dot product accumulated in dimension order (float64)."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0).cast("double"),
                       lambda s, x: s + x)


def l2_normalize(v: Column | str) -> Column:
    """Unit-normalise a vector; a zero vector is divided by 1 (stays zero)."""
    v = _c(v)
    norm = F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0).cast("double"),
                              lambda s, x: s + x))
    safe = F.coalesce(F.nullif(norm, F.lit(0.0)), F.lit(1.0))
    return F.transform(v, lambda x: x / safe)


def zero_for_blank(vec: Column | str, dims: int) -> Column:
    """Blank texts get an all-zero vector (so a blank trap never penalises)."""
    return F.coalesce(_c(vec), F.array_repeat(F.lit(0.0).cast("double"), dims))


def weighted_sum(vectors: list[Column], weights: list[float]) -> Column:
    """``w0*v0 + w1*v1 + ...`` element-wise, left to right."""
    def add(weight: float):
        return lambda s, x: s + F.lit(weight) * x

    acc = F.transform(vectors[0], lambda x: F.lit(weights[0]) * x)
    for v, w in zip(vectors[1:], weights[1:]):
        acc = F.zip_with(acc, v, add(w))
    return acc
