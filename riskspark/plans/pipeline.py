"""The engineered-table plan: loans -> clean -> features -> encode -> scale.

Fits (each one aggregate, scalars back to the driver):
  1. missing-value plan    (null counts of the raw table)
  2. winsor bounds         (p1/p99 of every numeric column)
  3. interaction cuts      (three quantiles)
  4. one-hot levels        (sorted distinct of the low-cardinality text columns)
  5. scaler                (mean / population std of the ten numeric features)
Everything between fits is narrow: filters and projections that Catalyst
collapses into one whole-stage-generated stage over the scan.

Quantiles are ranks over (column, value) counts, levels a grouping: no fit
sends a column to one task. A derived input (joins/aggregates in its plan) is
written once to the shared folder first, so those passes and the final
transform re-read Parquet instead of re-running the upstream joins (and a
lost executor costs one file, not the lineage).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from riskspark.functions import constants as K
from riskspark.functions.stats import fit_quantiles
from riskspark.operators import clean as C
from riskspark.operators import encode as E
from riskspark.operators import features as FE


@dataclass
class FittedPipeline:
    missing: C.MissingPlan
    winsor: C.WinsorBounds
    cuts: FE.InteractionCuts
    levels: dict[str, list[str]]
    scaler: E.ScalerParams
    source: DataFrame | None = None  # the input as the fits read it (the shared-folder copy if derived)


def cleaned(loans_df: DataFrame, missing: C.MissingPlan, winsor: C.WinsorBounds) -> DataFrame:
    return C.finalize(C.apply_winsor(C.apply_missing(loans_df, missing), winsor))


def fit_features(clean_df: DataFrame, accuracy: int | None = None):
    """Fits 3-5 over the base-feature projection: interaction cuts (ranks), one-hot levels (grouping)
    and scaler statistics (one aggregate). None of them gathers a column in one task."""
    base = FE.base_features(clean_df)
    q = fit_quantiles(base, [c for c in ("dti_n", "loan_amnt", "fico_n") if c in base.columns], [0.25, 0.75], accuracy)
    cuts = FE.InteractionCuts(q["dti_n"][1] if q.get("dti_n") else None,
                              q["loan_amnt"][1] if q.get("loan_amnt") else None,
                              q["fico_n"][0] if q.get("fico_n") else None)
    return cuts, E.fit_levels(base), E.fit_scaler(base)


def fit(loans_df: DataFrame, accuracy: int | None = None, materialize: bool | None = None,
        fit_on: str = "all"):
    """Fit the whole pipeline.

    A derived input -- one whose plan has joins or aggregates, like the
    ``loans`` view -- is written once to the shared folder first and the
    passes re-read Parquet; a plain file scan is read directly.

    ``fit_on="all"`` fits winsor bounds, interaction cuts and the scaler on
    every row (parity with the studied pipeline, which fits before it
    splits); ``fit_on="train"`` fits them on the training split only (no
    leakage into validation/test). Column decisions (missing-value plan,
    one-hot levels) always see the whole table.
    """
    if fit_on not in ("all", "train"):
        raise ValueError("fit_on must be 'all' or 'train'")
    source, missing = C.fit_missing_once(loans_df, "loans-input", materialize)   # pass 1 (+ write if derived)
    after_missing = C.apply_missing(source, missing)
    fit_rows = after_missing
    if fit_on == "train":
        from pyspark.sql import functions as F

        from riskspark.operators.split import stratified_split

        fit_rows = stratified_split(after_missing).filter(F.col("split") == "train").drop("split")
    winsor = C.fit_winsor(fit_rows, accuracy=accuracy)   # pass 2
    clean_df = C.finalize(C.apply_winsor(after_missing, winsor))
    fit_clean = clean_df if fit_on == "all" else C.finalize(C.apply_winsor(fit_rows, winsor))
    cuts, levels, scaler = fit_features(fit_clean, accuracy=accuracy)  # pass 3
    if fit_on == "train":  # levels are a column decision: take them from the whole table
        _, levels, _ = fit_features(clean_df, accuracy=accuracy)
    return FittedPipeline(missing, winsor, cuts, levels, scaler, source), clean_df


def transform_clean(clean_df: DataFrame, fitted: FittedPipeline, scale: bool = True) -> DataFrame:
    selected = FE.select_features(FE.engineer(clean_df, fitted.cuts))
    encoded = E.apply_one_hot(selected, fitted.levels)
    return E.apply_scaler(encoded, fitted.scaler) if scale else encoded


def engineered(loans_df: DataFrame, accuracy: int | None = None, materialize: bool | None = None,
               scale: bool = True, fit_on: str = "all") -> tuple[DataFrame, FittedPipeline]:
    """The 43-feature table (key ``id`` first, target ``Default``) and its fitted parameters."""
    fitted, clean_df = fit(loans_df, accuracy=accuracy, materialize=materialize, fit_on=fit_on)
    return transform_clean(clean_df, fitted, scale=scale), fitted


def model_columns(df: DataFrame, key: str = K.KEY, target: str = K.TARGET) -> list[str]:
    """The 43 feature columns in manifest order (everything but key and target)."""
    return [c for c in df.columns if c not in (key, target)]
