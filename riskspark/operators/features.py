"""Feature engineering F1-F16 with two profiles.

``training`` reproduces the engineering phase; ``serving`` reproduces how the
scoring service assembles the same 43 columns from five application fields
(different bins, thresholds and fixed defaults). Inputs that are absent are
skipped, the same "skip a feature when its inputs are missing" rule.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions import constants as K
from riskspark.functions.columns import col, flag, left_closed_bins, right_closed_bins, text_map
from riskspark.functions.stats import fit_quantiles

DATE_FORMATS = ["yyyy-MM-dd", "MMM-yyyy"]


def financial_ratios(df: DataFrame) -> dict[str, Column]:
    out = {}
    if "dti_n" in df.columns:
        out["DTI_ratio"] = col("dti_n")
    if "revenue" in df.columns and "loan_amnt" in df.columns:
        lti = F.when(col("revenue") > 0, col("loan_amnt") / col("revenue")).otherwise(F.lit(0.0))
        out["loan_to_income"] = F.least(F.greatest(lti, F.lit(0.0)), F.lit(K.LOAN_TO_INCOME_CAP))
    if "revenue" in df.columns:
        out["income_bracket"] = right_closed_bins(col("revenue"), K.INCOME_EDGES, K.INCOME_LABELS)
    return out


def parse_date(c: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Text -> timestamp over a list of formats; unparsable -> NULL (never an error)."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def temporal_features(df: DataFrame, formats: Sequence[str] = DATE_FORMATS) -> dict[str, Column]:
    if "issue_d" not in df.columns:
        return {}
    ts = parse_date(col("issue_d"), formats)
    return {"issue_year": F.year(ts), "issue_month": F.month(ts), "issue_quarter": F.quarter(ts)}


def employment_features(df: DataFrame) -> dict[str, Column]:
    if "emp_length" not in df.columns:
        return {}
    years = text_map(col("emp_length"), K.EMP_LENGTH_YEARS)
    return {"emp_length_numeric": years, "employment_stable": flag(years >= K.EMPLOYMENT_STABLE_YEARS)}


def credit_score_features(df: DataFrame) -> dict[str, Column]:
    if "fico_n" not in df.columns:
        return {}
    return {"fico_bracket": right_closed_bins(col("fico_n"), K.FICO_EDGES, K.FICO_LABELS),
            "high_fico": flag(col("fico_n") >= K.HIGH_FICO_TRAINING)}


def purpose_features(df: DataFrame) -> dict[str, Column]:
    if "purpose" not in df.columns:
        return {}
    return {"risky_loan_purpose": flag(col("purpose").isin(K.RISKY_PURPOSES)),
            "safe_loan_purpose": flag(col("purpose").isin(K.SAFE_PURPOSES))}


def home_ownership_features(df: DataFrame) -> dict[str, Column]:
    if "home_ownership_n" not in df.columns:
        return {}
    h = col("home_ownership_n")
    return {"is_homeowner": flag(h == "OWN"), "has_mortgage": flag(h == "MORTGAGE"), "is_renter": flag(h == "RENT")}


@dataclass
class InteractionCuts:
    dti_p75: float | None
    loan_p75: float | None
    fico_p25: float | None


def fit_interactions(df: DataFrame, accuracy: int | None = None) -> InteractionCuts:
    """F14/F15 fit: the three cut points in one aggregate."""
    want = [c for c in ("dti_n", "loan_amnt", "fico_n") if c in df.columns]
    q = fit_quantiles(df, want, [0.25, 0.75], accuracy)
    return InteractionCuts(q["dti_n"][1] if "dti_n" in q else None,
                           q["loan_amnt"][1] if "loan_amnt" in q else None,
                           q["fico_n"][0] if "fico_n" in q else None)


def interaction_features(df: DataFrame, cuts: InteractionCuts) -> dict[str, Column]:
    out = {}
    if "dti_n" in df.columns and "revenue" in df.columns and cuts.dti_p75 is not None:
        bracket = right_closed_bins(col("revenue"), K.INCOME_EDGES, K.INCOME_LABELS)
        out["high_debt_low_income"] = flag((col("dti_n") > F.lit(cuts.dti_p75))
                                           & bracket.isin(K.LOW_INCOME_BRACKETS))
    if "loan_amnt" in df.columns and "fico_n" in df.columns and cuts.loan_p75 is not None:
        out["high_loan_low_fico"] = flag((col("loan_amnt") > F.lit(cuts.loan_p75))
                                         & (col("fico_n") < F.lit(cuts.fico_p25)))
    return out


def with_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Add/replace columns in one projection (not a chain of withColumn)."""
    keep = [col(c) for c in df.columns if c not in new]
    return df.select(*keep, *[e.alias(k) for k, e in new.items()])


def base_features(df: DataFrame) -> DataFrame:
    """Every feature that needs no fitted parameter, one projection."""
    new: dict[str, Column] = {}
    for group in (financial_ratios, temporal_features, employment_features, credit_score_features,
                  purpose_features, home_ownership_features):
        new.update(group(df))
    return with_columns(df, new)


def engineer(df: DataFrame, cuts: InteractionCuts) -> DataFrame:
    """F1-F15 in one projection given the fitted interaction cuts."""
    new: dict[str, Column] = {}
    for group in (financial_ratios, temporal_features, employment_features, credit_score_features,
                  purpose_features, home_ownership_features):
        new.update(group(df))
    new.update(interaction_features(df, cuts))
    return with_columns(df, new)


def select_features(df: DataFrame, key: str | None = K.KEY, target: str = K.TARGET) -> DataFrame:
    """F16: numeric + binary + categorical + target, only those that exist (key kept first)."""
    present = set(df.columns)
    chosen = [c for c in K.NUMERIC_FEATURES + K.BINARY_FEATURES + K.CATEGORICAL_FEATURES if c in present]
    lead = [key] if key and key in present else []
    return df.select(*[col(c) for c in lead + chosen + [target]])


def serving_features(apps: DataFrame) -> DataFrame:
    """The 43 model columns from five application fields, as the scoring service builds them."""
    return apps.select(col("application_id"), *[e.alias(k) for k, e in serving_feature_exprs().items()])


def serving_feature_exprs() -> dict[str, Column]:
    """D5 as expressions over the raw fields, in manifest order.

    Numeric features are raw (scaled later with the stored scaler). Unset
    columns are 0; fixed defaults: renter, debt consolidation, 2025-12, Q4.
    """
    rev, loan, fico, dti, emp = (col("revenue"), col("loan_amnt"), col("fico_n"), col("dti_n"),
                                 col("emp_length_numeric"))
    d = lambda x: F.lit(float(x))
    f = lambda cond: flag(cond).cast("double")
    income = left_closed_bins(rev, K.INCOME_EDGES, K.INCOME_LABELS)
    fico_band = left_closed_bins(fico.cast("double"), [670.0, 740.0, 800.0, float("inf")],
                                 ["Good", "Very Good", "Excellent"])
    cols: dict[str, Column] = {
        "revenue": rev.cast("double"),
        "loan_amnt": loan.cast("double"),
        "fico_n": fico.cast("double"),
        "dti_n": dti * F.lit(100.0),
        "emp_length_numeric": emp.cast("double"),
        "loan_to_income": F.try_divide(loan, rev),
        "DTI_ratio": dti.cast("double"),
        "issue_year": d(K.SERVING_ISSUE_YEAR),
        "issue_month": d(K.SERVING_ISSUE_MONTH),
        "issue_quarter": d(K.SERVING_ISSUE_QUARTER),
        "employment_stable": f(emp >= K.EMPLOYMENT_STABLE_YEARS),
        "high_fico": f(fico >= K.SERVING_HIGH_FICO),
        "is_homeowner": d(0),
        "has_mortgage": d(0),
        "is_renter": d(1),
        "risky_loan_purpose": d(0),
        "safe_loan_purpose": d(1),
        "high_debt_low_income": f((dti > F.lit(K.SERVING_HIGH_DTI)) & (rev < F.lit(K.SERVING_LOW_REVENUE))),
        "high_loan_low_fico": f((loan > F.lit(K.SERVING_HIGH_LOAN)) & (fico < F.lit(K.SERVING_LOW_FICO))),
    }
    purposes = [p for p in _purpose_levels() if p != "car"]
    for p in purposes:
        cols[f"purpose_{p}"] = d(1 if p == K.SERVING_PURPOSE else 0)
    for h in ["OTHER", "OWN", "RENT"]:
        cols[f"home_ownership_n_{h}"] = d(1 if h == K.SERVING_HOME_OWNERSHIP else 0)
    for b in K.INCOME_LABELS[1:]:
        cols[f"income_bracket_{b}"] = f(income == b)
    for b in K.FICO_LABELS[1:]:
        cols[f"fico_bracket_{b}"] = f(fico_band == b)
    return cols


def _purpose_levels() -> list[str]:
    # The 14 purpose levels of the trained model, sorted.
    return ["car", "credit_card", "debt_consolidation", "educational", "home_improvement", "house",
            "major_purchase", "medical", "moving", "other", "renewable_energy", "small_business",
            "vacation", "wedding"]


SERVING_PURPOSE_LEVELS = _purpose_levels()


def features(df: DataFrame, profile: str = "training", cuts: InteractionCuts | None = None) -> DataFrame:
    """The feature groups under one name: ``training`` (F1-F15 on a loan table; interaction
    cuts fitted here unless given) or ``serving`` (D5 on an application table)."""
    if profile == "serving":
        return serving_features(df)
    if profile != "training":
        raise ValueError("profile must be 'training' or 'serving'")
    return engineer(df, cuts if cuts is not None else fit_interactions(df))
