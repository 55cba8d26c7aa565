"""One-hot encoding, standard scaling and the feature manifest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.functions import constants as K
from riskspark.functions.columns import col, r6

# Bracket columns have declared levels (label order, unobserved ones included).
DECLARED_LEVELS = {"income_bracket": K.INCOME_LABELS, "fico_bracket": K.FICO_LABELS}
MAX_LEVELS = 1000


def fit_levels(df: DataFrame, columns: Sequence[str] = tuple(K.CATEGORICAL_FEATURES),
               max_levels: int = MAX_LEVELS) -> dict[str, list[str]]:
    """F17 fit: sorted observed levels of text columns, declared ones for brackets.

    The distinct (column, value) pairs come from one grouping (combined before the shuffle) and are
    counted before any of them reaches the driver; a column with more than ``max_levels`` levels is
    an error, as each level would become a column.
    """
    observed = [c for c in columns if c in df.columns and c not in DECLARED_LEVELS]
    levels = {c: list(DECLARED_LEVELS[c]) for c in columns if c in DECLARED_LEVELS and c in df.columns}
    if observed:
        pairs = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), col(c).cast("string").alias("v")) for c in observed])))
        seen = pairs.where("v IS NOT NULL").distinct()
        for r in seen.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each column
            if r["n"] > max_levels:
                raise ValueError(f"{r['c']}: {r['n']} levels exceed {max_levels}; not a categorical column")
        levels.update({c: [] for c in observed})
        for r in seen.collect():  # at most max_levels rows for each column
            levels[r["c"]].append(r["v"])
        for c in observed:
            levels[c].sort()
    return {c: levels[c] for c in columns if c in levels}


def apply_one_hot(df: DataFrame, levels: dict[str, list[str]], drop_first: bool = True) -> DataFrame:
    """Integer dummies ``<col>_<level>``; the first level is the reference; unseen -> all 0.
    Encoded columns come after all other columns, in the order of ``levels``."""
    rest = [col(c) for c in df.columns if c not in levels]
    dummies = []
    for c, lv in levels.items():
        for level in (lv[1:] if drop_first else lv):
            dummies.append(F.coalesce(col(c) == F.lit(level), F.lit(False)).cast("int").alias(f"{c}_{level}"))
    return df.select(*rest, *dummies)


@dataclass
class ScalerParams:
    mean: dict[str, float]
    std: dict[str, float]


def fit_scaler(df: DataFrame, columns: Sequence[str] = tuple(K.NUMERIC_FEATURES)) -> ScalerParams:
    """F18 fit: mean and population std of each numeric feature, one aggregate.

    A constant column gets std 1 (it scales to 0). It is told by min = max, as the merged variance of
    a constant that has no exact binary form is only nearly 0; its mean is then that value itself.
    """
    cols = [c for c in columns if c in df.columns]
    aggs = []
    for i, c in enumerate(cols):
        x = col(c).cast("double")
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
    row = df.agg(*aggs).first()
    same = {c: row[f"a{i}"] is not None and row[f"a{i}"] == row[f"b{i}"] for i, c in enumerate(cols)}
    mean = {c: row[f"a{i}"] if same[c] else row[f"m{i}"] for i, c in enumerate(cols)}
    std = {c: 1.0 if same[c] or row[f"s{i}"] in (None, 0.0) else row[f"s{i}"] for i, c in enumerate(cols)}
    return ScalerParams(mean, std)


def apply_scaler(df: DataFrame, params: ScalerParams) -> DataFrame:
    return df.select(*[((col(c).cast("double") - F.lit(params.mean[c])) / F.lit(params.std[c])).alias(c)
                       if c in params.mean else col(c) for c in df.columns])


def scale_check(df: DataFrame, columns: Sequence[str] = tuple(K.NUMERIC_FEATURES)) -> DataFrame:
    """mean of the column means (~0) and mean of the sample stds (~1), one aggregate."""
    cols = [c for c in columns if c in df.columns]
    wide = df.agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                  *[F.stddev_samp(col(c)).alias(f"s{i}") for i, c in enumerate(cols)])
    k = F.lit(float(len(cols)))
    mean_of_means = sum([F.col(f"m{i}") for i in range(1, len(cols))], F.col("m0")) / k
    mean_of_stds = sum([F.col(f"s{i}") for i in range(1, len(cols))], F.col("s0")) / k
    return wide.select(F.lit(len(cols)).alias("n_scaled"), r6(mean_of_means).alias("mean_of_means"),
                       r6(mean_of_stds).alias("mean_of_stds"))


def feature_manifest(df: DataFrame, key: str | None = K.KEY, target: str = K.TARGET) -> DataFrame:
    """one row per model column -- position, group, and the table-level n_features / n_samples."""
    names = [c for c in df.columns if c != key]
    groups = []
    for c in names:
        if c == target:
            g = "target"
        elif c in K.NUMERIC_FEATURES:
            g = "numeric"
        elif c in K.BINARY_FEATURES:
            g = "binary"
        else:
            g = "categorical_dummy"
        groups.append(g)
    n_features = len(names) - (1 if target in names else 0)
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.lit(g).alias("feature_group"))
                     for i, (c, g) in enumerate(zip(names, groups))])
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("n_samples")).select(
        F.inline(rows), F.lit(n_features).alias("n_features"), "n_samples")
