"""Cleaning (C2-C4, C8, C13, C14) as fit / apply pairs.

A fit is one aggregate whose tiny result goes to the driver; an apply is a
narrow projection/filter with the fitted scalars inlined as literals.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.functions import constants as K
from riskspark.functions.columns import clip, col, is_text, numeric_columns
from riskspark.functions.stats import fit_quantiles
from riskspark.session import reusable


@dataclass
class MissingPlan:
    drop_columns: list[str] = field(default_factory=list)
    dropna_columns: list[str] = field(default_factory=list)
    fill_columns: list[str] = field(default_factory=list)
    fill_value: str = K.TEXT_FILL


def _missing_aggs(df: DataFrame) -> list:
    aggs = [F.count(F.lit(1)).alias("_rows")] + [F.count(col(c)).alias(f"_nn{i}") for i, c in enumerate(df.columns)]
    return aggs


def _plan_from_counts(df: DataFrame, row, drop_pct: float, act_pct: float) -> MissingPlan:
    n = row["_rows"]
    plan = MissingPlan()
    if not n:
        return plan
    for i, f in enumerate(df.schema.fields):
        miss = n - row[f"_nn{i}"]
        pct = miss / n * 100
        if miss <= 0:
            continue
        if pct > drop_pct:
            plan.drop_columns.append(f.name)
        elif pct < act_pct:
            (plan.fill_columns if is_text(f) else plan.dropna_columns).append(f.name)
    return plan


def fit_missing(df: DataFrame, drop_pct: float = K.DROP_COLUMN_MISSING_PCT,
                act_pct: float = K.ACT_ON_MISSING_PCT) -> MissingPlan:
    """C2-C4 decisions from ONE null-count aggregate (percentages before any drop)."""
    return _plan_from_counts(df, df.agg(*_missing_aggs(df)).first(), drop_pct, act_pct)


def materialize_and_fit_missing(df: DataFrame, name: str, drop_pct: float = K.DROP_COLUMN_MISSING_PCT,
                                act_pct: float = K.ACT_ON_MISSING_PCT) -> tuple[DataFrame, MissingPlan]:
    """Write a derived input to the shared folder, then fit C2-C4 on the Parquet copy.

    (Fusing the two with ``DataFrame.observe`` would save the scan, but on
    Spark 4.1 an observed session can no longer serialize MLlib transforms,
    so the fit reads the written files instead.)
    """
    from riskspark.session import materialize

    src = materialize(df, name)
    return src, fit_missing(src, drop_pct, act_pct)


def fit_missing_once(df: DataFrame, name: str = "loans-input", materialize: bool | None = None):
    """(input to read from now on, missing plan): a derived input is written once, fitted on the way."""
    from riskspark.session import is_plain_scan

    if materialize is None:
        materialize = not is_plain_scan(df)
    if materialize:
        return materialize_and_fit_missing(df, name)
    return df, fit_missing(df)


def apply_missing(df: DataFrame, plan: MissingPlan) -> DataFrame:
    out = df.drop(*plan.drop_columns) if plan.drop_columns else df
    if plan.dropna_columns:
        cond = None
        for c in plan.dropna_columns:
            cond = col(c).isNotNull() if cond is None else cond & col(c).isNotNull()
        out = out.filter(cond)
    if plan.fill_columns:
        out = out.select(*[F.coalesce(col(c), F.lit(plan.fill_value)).alias(c) if c in plan.fill_columns else col(c)
                           for c in out.columns])
    return out


def clean_missing(df: DataFrame) -> DataFrame:
    return apply_missing(df, fit_missing(df))


@dataclass
class WinsorBounds:
    bounds: dict[str, tuple[float, float]]


def fit_winsor(df: DataFrame, columns: Sequence[str] | None = None, low: float = K.WINSOR_LOW,
               high: float = K.WINSOR_HIGH, exclude: Sequence[str] = (K.KEY, K.TARGET),
               accuracy: int | None = None) -> WinsorBounds:
    """C8 fit: the p1 / p99 of every numeric column.

    Key and target are excluded by default: clipping them would make ids
    collide and could flatten a rare class.
    """
    cols = list(columns) if columns is not None else numeric_columns(df, exclude)
    q = fit_quantiles(df, cols, [low, high], accuracy)
    return WinsorBounds({c: (q[c][0], q[c][1]) for c in cols if q[c][0] is not None})


def apply_winsor(df: DataFrame, fitted: WinsorBounds) -> DataFrame:
    """Clip into [p1, p99]; NULL stays NULL. Clipped columns become double."""
    return df.select(*[clip(col(c), F.lit(lo), F.lit(hi)).cast("double").alias(c) if c in fitted.bounds
                       else col(c) for c in df.columns for lo, hi in [fitted.bounds.get(c, (None, None))]])


def winsorize(df: DataFrame, **kw) -> DataFrame:
    df = reusable(df, "winsor-input")  # fit passes + apply: a derived input is written once
    return apply_winsor(df, fit_winsor(df, **kw))


def finalize(df: DataFrame, target: str = K.TARGET, exclude: Sequence[str] = ()) -> DataFrame:
    """Drop rows without a target and rows with +-inf in any numeric column."""
    cond = col(target).isNotNull()
    for c in numeric_columns(df, exclude):
        dt = df.schema[c].dataType.simpleString()
        if dt in ("double", "float"):
            cond = cond & F.coalesce(F.abs(col(c)) != F.lit(float("inf")), F.lit(True))
    return df.filter(cond)


def clean(df: DataFrame, accuracy: int | None = None) -> DataFrame:
    """C2-C4 -> C8 -> C13-C14, the cleaning phase as one lazy plan (two fits)."""
    df, plan = fit_missing_once(df, "clean-input")
    missing_done = apply_missing(df, plan)
    return finalize(apply_winsor(missing_done, fit_winsor(missing_done, accuracy=accuracy)))
