"""Statistic expressions shared by the profiling operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null when b is 0 or null (ANSI mode raises on x / 0)."""
    return a / F.nullif(b, F.lit(0))


def sample_skewness(n: Column, g1: Column) -> Column:
    """Bias-corrected skewness from Spark's population skewness; 0 when n <= 2
    or when the column has no spread."""
    corr = g1 * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n > 2, F.coalesce(F.nanvl(corr, F.lit(0.0)), F.lit(0.0))).otherwise(F.lit(0.0))


def sample_kurtosis(n: Column, g2: Column) -> Column:
    """Bias-corrected excess kurtosis from Spark's population excess kurtosis;
    0 when n <= 3 or when the column has no spread."""
    corr = ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))
    return F.when(n > 3, F.coalesce(F.nanvl(corr, F.lit(0.0)), F.lit(0.0))).otherwise(F.lit(0.0))


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(safe_div(part.cast("double") * 100.0, whole.cast("double")), digits)
