"""Numeric column expressions shared by every scoring path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantize(x: Column) -> Column:
    """Fixed-point nano units: ``floor(x * 1e9 + 0.5)`` as BIGINT.

    Ranks compare these integers, so ties are decided the same way by every
    engine (Spark, DuckDB, NumPy) instead of by the last bit of a double.
    """
    return F.floor(x * F.lit(1e9) + F.lit(0.5))


def minmax_denominator(mn: Column, mx: Column) -> Column:
    """``max - min``, or 1 when all scores of the query are equal."""
    return F.when(mx == mn, F.lit(1.0)).otherwise(mx - mn)


def minmax(x: Column, mn: Column, mx: Column) -> Column:
    """Per-query min-max normalisation into [0, 1]."""
    return (x - mn) / minmax_denominator(mn, mx)


def ratio(num: Column, den: Column) -> Column:
    """Double division of two counts."""
    return num.cast("double") / den.cast("double")
