"""Structural validation and quality profile.

Every per-column metric of a report is computed in ONE fused aggregate over
all columns; the wide one-row result is unpivoted into a long report, so a
report is one scan regardless of the number of columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions import constants as K
from riskspark.functions.columns import col, is_text, numeric_columns, r6, safe_div, text_columns, type_class
from riskspark.functions.stats import adjusted_kurtosis, adjusted_skewness, fit_quantiles
from riskspark.session import materialize, reusable


def _fingerprint(df: DataFrame) -> list:
    """128-bit row fingerprint plus null masks, a bit a column (hash functions skip NULLs, the masks tell them apart)."""
    cols = [col(c) for c in df.columns]
    masks = []
    for at in range(0, max(len(cols), 1), 62):
        mask = F.lit(0).cast("long")
        for i, c in enumerate(cols[at:at + 62]):
            mask = mask + F.when(c.isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
        masks.append(mask.alias(f"_m{at}"))
    return [F.xxhash64(*cols).alias("_h1"), F.xxhash64(*reversed(cols), F.lit(0x5EED)).alias("_h2"), *masks]


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row (NULL equals NULL), exact, without shuffling whole rows.

    1. shuffle only fingerprints: ``groupBy(h1, h2, null masks).count()`` (map-side
       combined, so a row repeated a third of the table is one record per task);
       the few that occur more than once are written to the shared folder with the
       number of rows that all others stand for;
    2. rows with such a fingerprint are the only candidates: a left-semi join (AQE
       broadcasts the candidate set when it is small); none: no second pass;
    3. the candidates are grouped by their full content -- so a fingerprint
       collision can never merge two different rows -- and counted exactly.

    A derived input is written once, both passes read that copy.
    """
    src = reusable(df, "duplicates-input")
    marks = _fingerprint(src)
    fp = src.select("*", *marks)
    keys = [c for c in fp.columns if c not in src.columns]
    per_fp = fp.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # single fingerprints merge into one row, so the written table holds the repeated ones only
    once = F.col("_n") == 1
    table = materialize(per_fp.groupBy(*[F.when(~once, F.col(k)).alias(k) for k in keys], once.alias("_once")).agg(F.sum("_n").alias("_n")), "fingerprints")
    rows, repeated = table.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count_if(~F.col("_once"))).first()
    dup = 0
    if repeated:
        candidates = fp.join(table.where("NOT _once").select(*keys), keys, "left_semi").drop(*keys)
        dup = candidates.groupBy(*[col(c) for c in src.columns]).agg(F.count(F.lit(1)).alias("_n")).agg(
            F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("d")).first()["d"]
    spark = df.sparkSession
    return spark.createDataFrame([(int(dup), int(rows) - int(dup))], "duplicate_rows bigint, distinct_rows bigint")


def _grouped_profile(df: DataFrame, target: str | None = None) -> DataFrame:
    """ONE row with everything the structural reports need.

    Column counts (and target statistics) are one shuffle-free aggregate over
    the scan; duplicates come from ``duplicate_count`` (fingerprints only).
    Both results are single rows of scalars, assembled into one row.
    """
    df = reusable(df, "profile-input")  # read for the counts and for the duplicates
    aggs = [F.count(F.lit(1)).alias("_rows")] + [F.count(col(c)).alias(f"_nn{i}") for i, c in enumerate(df.columns)]
    with_target = target is not None and target in df.columns
    if with_target:
        aggs += [F.count_if(col(target) == 1).alias("_pos"), F.avg(col(target).cast("double")).alias("_rate")]
    counts = df.agg(*aggs).first()
    dup = duplicate_count(df).first()
    names = ["_rows", "distinct_rows", "duplicate_rows"] + [f"_nn{i}" for i in range(len(df.columns))]
    values = [counts["_rows"], dup["distinct_rows"], dup["duplicate_rows"]] + [counts[f"_nn{i}"]
                                                                              for i in range(len(df.columns))]
    schema = ", ".join(f"{n} bigint" for n in names)
    if with_target:
        names += ["_pos", "_rate"]
        values += [counts["_pos"], counts["_rate"]]
        schema += ", _pos bigint, _rate double"
    return df.sparkSession.createDataFrame([tuple(int(v) if isinstance(v, int) else v for v in values)], schema)


def _base_counts(df: DataFrame) -> DataFrame:
    """One row: n, and non-null count per column (position-indexed aliases). A plain scan."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.count(col(c)).alias(f"_nn{i}") for i, c in enumerate(df.columns)]
    return df.agg(*aggs)


def validate_structure(df: DataFrame, target: str = K.TARGET,
                       rows_min: int = K.ROWS_MIN, rows_max: int = K.ROWS_MAX,
                       cols_min: int = K.COLUMNS_MIN, cols_max: int = K.COLUMNS_MAX,
                       dup_max_share: float = K.DUPLICATE_MAX_SHARE) -> DataFrame:
    """Q1-Q7: one row per check (check, observed, lo, hi, ok, error) plus the verdict row."""
    ncols = len(df.columns)
    all_null = [F.when(F.col(f"_nn{i}") == 0, F.lit(c)) for i, c in enumerate(df.columns)]
    wide = _grouped_profile(df).select(
        F.col("_rows").alias("n"),
        F.col("duplicate_rows"),
        F.concat_ws(", ", *all_null).alias("null_cols"),
        F.size(F.array_compact(F.array(*all_null))).alias("n_null_cols"),
    )
    n = F.col("n")
    fmt = lambda x: F.format_number(x.cast("double"), 0)  # noqa: E731  thousands separators
    checks = [
        ("row_count", n.cast("double"), F.lit(float(rows_min)), F.lit(float(rows_max)),
         (n >= rows_min) & (n <= rows_max),
         F.format_string("Row count %s outside expected range [%s, %s]", fmt(n),
                         F.lit(f"{rows_min:,}"), F.lit(f"{rows_max:,}"))),
        ("column_count", F.lit(float(ncols)), F.lit(float(cols_min)), F.lit(float(cols_max)),
         F.lit(cols_min <= ncols <= cols_max),
         F.lit(f"Column count {ncols} outside expected range [{cols_min}, {cols_max}]")),
        ("target_present", F.lit(1.0 if target in df.columns else 0.0), F.lit(1.0), F.lit(1.0),
         F.lit(target in df.columns), F.lit(f"Target column '{target}' not found")),
        ("non_empty", n.cast("double"), F.lit(1.0), F.lit(None).cast("double"), n > 0,
         F.lit("DataFrame is completely empty")),
        ("all_null_columns", F.col("n_null_cols").cast("double"), F.lit(0.0), F.lit(0.0),
         F.col("n_null_cols") == 0,
         F.concat(F.lit("Columns with all null values: ["), F.col("null_cols"), F.lit("]"))),
        ("duplicate_rows", F.col("duplicate_rows").cast("double"), F.lit(0.0), n * F.lit(dup_max_share),
         F.col("duplicate_rows") <= n * F.lit(dup_max_share),
         F.format_string("High duplicate count: %s rows (%.2f%%)", fmt(F.col("duplicate_rows")),
                         safe_div(F.col("duplicate_rows"), n) * 100)),
    ]
    rows = []
    for name, observed, lo, hi, ok, err in checks:
        rows.append(F.struct(F.lit(name).alias("check"), observed.alias("observed"), lo.alias("lo"),
                             hi.alias("hi"), ok.cast("int").alias("ok"),
                             F.when(~ok, err).alias("error")))
    all_ok = None
    for _, _, _, _, ok, _ in checks:
        all_ok = ok if all_ok is None else (all_ok & ok)
    rows.append(F.struct(F.lit("is_valid").alias("check"), F.lit(None).cast("double").alias("observed"),
                         F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
                         all_ok.cast("int").alias("ok"), F.lit(None).cast("string").alias("error")))
    return wide.select(F.inline(F.array(*rows)))


def _profile_columns(df: DataFrame) -> list:
    ncols = len(df.columns)
    classes = [type_class(f) for f in df.schema.fields]
    n = F.col("_rows")
    missing = [n - F.col(f"_nn{i}") for i in range(ncols)]
    total_missing = sum(missing[1:], missing[0]) if missing else F.lit(0)
    with_missing = F.concat_ws(", ", *[F.when(m > 0, F.lit(c)) for m, c in zip(missing, df.columns)])
    return [
        n.cast("bigint").alias("rows"),
        F.lit(ncols).cast("bigint").alias("columns"),
        F.col("duplicate_rows"),
        F.lit(sum(c in ("int64", "float64") for c in classes)).cast("bigint").alias("numeric_columns"),
        F.lit(sum(c == "object" for c in classes)).cast("bigint").alias("object_columns"),
        F.lit(sum(c == "datetime64" for c in classes)).cast("bigint").alias("datetime_columns"),
        F.lit(0).cast("bigint").alias("categorical_columns"),
        total_missing.cast("bigint").alias("total_missing"),
        r6(safe_div(total_missing, n * F.lit(ncols)) * 100).alias("missing_pct"),
        with_missing.alias("columns_with_missing"),
    ]


def quality_profile(df: DataFrame, target: str = K.TARGET) -> DataFrame:
    """Q8-Q10: one row of basic info, type-class counts and missing totals (one shuffle)."""
    return _grouped_profile(df).select(*_profile_columns(df))


def target_distribution(df: DataFrame, target: str = K.TARGET) -> DataFrame:
    """Q11: count and share per target value, and the default rate (mean of the target).

    One grouped aggregate; the totals come from a window over its (two-row) result.
    """
    per_class = df.groupBy(col(target).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    total = F.sum("n").over(w)
    rate = F.sum(F.col("label") * F.col("n")).over(w) / F.sum(F.when(F.col("label").isNotNull(), F.col("n"))).over(w)
    return per_class.select("label", "n", (F.col("n") / total).alias("_share"), rate.alias("_rate")).filter(
        F.col("label").isNotNull()).select(
        "label", F.col("n").cast("bigint").alias("n"), r6(F.col("_share")).alias("share"),
        r6(F.col("_rate")).alias("default_rate"))


def column_non_null(df: DataFrame) -> DataFrame:
    """Q12: column, position, dtype class, non-null count -- one aggregate then unpivot."""
    counts = _base_counts(df)
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"),
                     F.lit(type_class(f)).alias("dtype"), F.col(f"_nn{i}").cast("bigint").alias("non_null"))
            for i, (c, f) in enumerate(zip(df.columns, df.schema.fields))]
    return counts.select(F.inline(F.array(*rows)))


def missing_report(df: DataFrame, drop_pct: float = K.DROP_COLUMN_MISSING_PCT,
                   act_pct: float = K.ACT_ON_MISSING_PCT) -> DataFrame:
    """Column, missing count, percent, planned action; only columns with missing values,
    sorted by percent descending (column name breaks ties)."""
    counts = _base_counts(df)
    n = F.col("_rows")
    rows = []
    for i, f in enumerate(df.schema.fields):
        miss = n - F.col(f"_nn{i}")
        pct = safe_div(miss, n) * 100
        if is_text(f):
            small = F.lit("fill_unknown")
        else:
            small = F.lit("drop_rows")
        action = F.when(pct > drop_pct, F.lit("drop_column")).when(pct < act_pct, small).otherwise(F.lit("none"))
        rows.append(F.struct(F.lit(f.name).alias("column_name"), miss.cast("bigint").alias("missing_count"),
                             pct.alias("missing_pct"), action.alias("action")))
    report = counts.select(F.inline(F.array(*rows))).filter(F.col("missing_count") > 0)
    return report.select("column_name", "missing_count", r6(F.col("missing_pct")).alias("missing_pct"),
                         "action").orderBy(F.desc("missing_pct"), "column_name")


def low_cardinality(df: DataFrame, max_distinct: int = K.LOW_CARDINALITY_MAX,
                    approximate: bool = False) -> DataFrame:
    """Distinct count per text column (NULL ignored) and the low-cardinality flag."""
    cols = text_columns(df)
    if approximate:
        wide = df.agg(*[F.approx_count_distinct(col(c)).alias(f"_d{i}") for i, c in enumerate(cols)])
    else:  # one grouping by (column, value), combined before the shuffle
        pairs = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), col(c).alias("v")) for i, c in enumerate(cols)])))
        wide = pairs.where("v IS NOT NULL").distinct().agg(*[F.count_if(F.col("i") == i).alias(f"_d{i}") for i in range(len(cols))])
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"_d{i}").cast("bigint").alias("n_distinct"),
                     (F.col(f"_d{i}") < max_distinct).cast("int").alias("low_cardinality"))
            for i, c in enumerate(cols)]
    return wide.select(F.inline(F.array(*rows)))


def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None, factor: float = K.IQR_FACTOR,
                 top: int = 10, exclude: Sequence[str] = (K.KEY, K.TARGET),
                 accuracy: int | None = None) -> DataFrame:
    """Outliers strictly outside [Q1 - 1.5 IQR, Q3 + 1.5 IQR]; zero-count columns omitted,
    top ``top`` by percent. Pass 1: all quartiles in one aggregate; pass 2: all counts in one."""
    df = reusable(df, "iqr-input")  # three passes below: a derived input is written once
    cols = list(columns) if columns is not None else numeric_columns(df, exclude)
    q = fit_quantiles(df, cols, [0.25, 0.75], accuracy)
    bounds = {}
    for c in cols:
        q1, q3 = q[c]
        if q1 is None:
            continue
        iqr = q3 - q1
        bounds[c] = (q1 - factor * iqr, q3 + factor * iqr)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        if c in bounds:
            lo, hi = bounds[c]
            aggs.append(F.count_if((col(c) < F.lit(lo)) | (col(c) > F.lit(hi))).alias(f"_o{i}"))
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"_o{i}").cast("bigint").alias("outliers"),
                     (F.col(f"_o{i}") / F.col("_rows") * 100).alias("pct"),
                     F.lit(bounds[c][0]).alias("lower_bound"), F.lit(bounds[c][1]).alias("upper_bound"))
            for i, c in enumerate(cols) if c in bounds]
    if not rows:
        return wide.select(F.lit(None).cast("string").alias("column_name")).filter(F.lit(False))
    long = wide.select(F.inline(F.array(*rows))).filter(F.col("outliers") > 0)
    return long.orderBy(F.desc("pct"), "column_name").limit(top).select(
        "column_name", "outliers", r6(F.col("pct")).alias("pct"),
        r6(F.col("lower_bound")).alias("lower_bound"), r6(F.col("upper_bound")).alias("upper_bound"))


def class_balance(df: DataFrame, target: str = K.TARGET) -> DataFrame:
    """Per class count and percent, plus the imbalance ratio n0 / n1 on every row."""
    per = df.filter(col(target).isNotNull()).groupBy(col(target).alias("label")).agg(
        F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()  # two rows at most: a global window over the grouped result
    ratio = (F.max(F.when(F.col("label") == 0, F.col("n"))).over(w)
             / F.max(F.when(F.col("label") == 1, F.col("n"))).over(w))
    return per.select("label", F.col("n").cast("bigint").alias("n"),
                      r6(F.col("n") / F.sum("n").over(w) * 100).alias("pct"),
                      r6(ratio).alias("imbalance_ratio"))


def statistical_summary(df: DataFrame, columns: Sequence[str] | None = None,
                        accuracy: int | None = None) -> DataFrame:
    """Count, mean, std (n-1), min, quartiles, max, G1, G2 per numeric column.

    Two passes whatever the number of columns: (1) every moment of every
    column, one aggregate; (2) the exact quartiles by ranks. The report is the unpivot of the two one-row results.
    """
    df = reusable(df, "summary-input")  # two passes below: a derived input is written once
    cols = list(columns) if columns is not None else numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        x = col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"),
                 F.skewness(x).alias(f"g1{i}"), F.kurtosis(x).alias(f"g2{i}")]
    row = df.agg(*aggs).first()
    quart = fit_quantiles(df, cols, [0.25, 0.5, 0.75], accuracy)
    spark = df.sparkSession
    lit_rows = []
    for i, c in enumerate(cols):
        lit_rows.append((c, row[f"n{i}"], row[f"m{i}"], row[f"s{i}"], row[f"lo{i}"], *quart[c], row[f"hi{i}"],
                         row[f"g1{i}"], row[f"g2{i}"]))
    wide = spark.createDataFrame(lit_rows, "column_name string, n long, m double, s double, lo double, "
                                           "p25 double, p50 double, p75 double, hi double, g1 double, g2 double")
    n = F.col("n")
    return wide.select(
        "column_name", n.cast("bigint").alias("count"), r6(F.col("m")).alias("mean"), r6(F.col("s")).alias("std"),
        r6(F.col("lo")).alias("min"), r6(F.col("p25")).alias("p25"), r6(F.col("p50")).alias("p50"),
        r6(F.col("p75")).alias("p75"), r6(F.col("hi")).alias("max"),
        r6(adjusted_skewness(F.col("g1"), n)).alias("skewness"),
        r6(adjusted_kurtosis(F.col("g2"), n)).alias("kurtosis"))


def top_std(summary: DataFrame, k: int = 5) -> DataFrame:
    """The k columns with the largest standard deviation (a top-k report)."""
    return summary.orderBy(F.desc("std"), "column_name").limit(k).select("column_name", "mean", "std", "min", "max")


def dataset_metadata(df: DataFrame, target: str = K.TARGET) -> DataFrame:
    """S6 (flat form): the dataset metadata record as one row, from the same single shuffle."""
    return _grouped_profile(df, target).select(*_profile_columns(df), "_pos", "_rate").select(
        "rows", "columns", "duplicate_rows", "total_missing", "missing_pct", "columns_with_missing",
        F.col("_pos").alias("n_default"), r6(F.col("_rate")).alias("default_rate"),
        F.lit(target).alias("target_column"),
    )


def column_metadata(df: DataFrame) -> DataFrame:
    """S6, per column: position, name, type and the missing values (counts of one aggregate)."""
    wide = _base_counts(df)
    rows = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("dtype"),
                              F.col(f"_nn{i}").alias("non_null"), (F.col("_rows") - F.col(f"_nn{i}")).alias("missing")) for i, f in enumerate(df.schema.fields)])
    return wide.select(F.inline(rows))
