"""Aggregate helpers: fused quantiles and sample-adjusted moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions.columns import col


def sketch_expr(c: Column, probs: Sequence[float], accuracy: int) -> Column:
    """Approximate quantiles from a sketch whose size depends on ``accuracy`` only."""
    return F.percentile_approx(c.cast("double"), F.array(*[F.lit(float(p)) for p in probs]), accuracy)


def distinct_estimates(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """HyperLogLog distinct-count estimate of every column, one pass, fixed-size state."""
    if not columns:
        return {}
    row = df.agg(*[F.approx_count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    return {c: int(row[f"d{i}"]) for i, c in enumerate(columns)}


def fit_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                  accuracy: int | None = None) -> dict[str, list[float | None]]:
    """Exact linear-interpolation quantiles of many columns, or with ``accuracy`` a bounded-size sketch.

    One plan at every size: a sketch brackets each quantile, a scan counts, the few values inside are ranked
    (``quantiles.exact_quantiles``). No task holds a map of all values of a column, and the data is not shuffled.
    """
    from riskspark.functions.quantiles import exact_quantiles

    cols = list(columns)
    if not cols:
        return {}
    if accuracy is not None:
        row = df.agg(*[sketch_expr(col(c), probs, accuracy).alias(f"q{i}") for i, c in enumerate(cols)]).first()
        return {c: (list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs))
                for i, c in enumerate(cols)}
    return exact_quantiles(df, cols, probs)


def adjusted_skewness(g1: Column, n: Column) -> Column:
    """Sample skewness G1 from the population g1; 0 for a constant column."""
    n = n.cast("double")
    adj = g1 * F.sqrt(n * (n - 1)) / (n - 2)
    return F.coalesce(F.when(n > 2, adj), F.lit(0.0))


def adjusted_kurtosis(g2: Column, n: Column) -> Column:
    """Sample excess kurtosis G2 from the population g2; 0 for a constant column."""
    n = n.cast("double")
    adj = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return F.coalesce(F.when(n > 3, adj), F.lit(0.0))
