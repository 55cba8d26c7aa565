"""Cleaning thresholds, winsorising, duplicates, constant columns."""

from pyspark.sql import functions as F

from riskspark.operators import clean as C
from riskspark.operators import encode as E
from riskspark.operators import profile as P


def _frame_with_missing(spark, pct_by_col, n=1000):
    rows = []
    for i in range(n):
        row = [i]
        for c, pct in pct_by_col.items():
            k = int(round(n * pct / 100))
            row.append(None if i < k else float(i))
        rows.append(tuple(row))
    schema = "id long, " + ", ".join(f"{c} double" for c in pct_by_col)
    return spark.createDataFrame(rows, schema)


def test_missing_share_thresholds(spark):
    df = _frame_with_missing(spark, {"a0": 0, "a49": 4.9, "a5": 5.0, "a50": 50.0, "a501": 50.1})
    plan = C.fit_missing(df)
    assert plan.drop_columns == ["a501"]
    assert plan.dropna_columns == ["a49"]
    assert plan.fill_columns == []


def test_text_fill_unknown(spark):
    df = spark.createDataFrame([(i, None if i < 3 else "x") for i in range(100)], "id long, t string")
    out = C.clean_missing(df)
    assert out.filter(F.col("t") == "Unknown").count() == 3


def test_winsor_keeps_null_and_never_widens(spark):
    rows = [(i, float(i)) for i in range(1, 101)] + [(101, None), (102, 10000.0)]
    df = spark.createDataFrame(rows, "id long, x double")
    fitted = C.fit_winsor(df, exclude=("id",))
    out = C.apply_winsor(df, fitted)
    r = {row["id"]: row["x"] for row in out.collect()}
    assert r[101] is None
    lo, hi = fitted.bounds["x"]
    assert all(v is None or lo <= v <= hi for v in r.values())
    assert lo >= 1.0 and hi <= 10000.0


def test_duplicates_rule(spark):
    base = [(i, f"v{i}") for i in range(100)]
    one_copy = spark.createDataFrame(base + [base[0]], "id long, v string")
    two_copies = spark.createDataFrame(base + [base[0], base[1]], "id long, v string")
    def dup_ok(df):
        rows = {r["check"]: r for r in P.validate_structure(df, rows_min=1, cols_min=1, target="id").collect()}
        return rows["duplicate_rows"]["ok"], rows["duplicate_rows"]["observed"]
    assert dup_ok(one_copy) == (1, 1.0)
    assert dup_ok(two_copies) == (0, 2.0)


def test_null_rows_count_as_duplicates(spark):
    df = spark.createDataFrame([(None, None), (None, None), (1, "a")], "a long, b string")
    assert P.duplicate_count(df).first()["duplicate_rows"] == 1


def test_constant_column_moments_and_scaling(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (5.0,)], "c double")
    s = P.statistical_summary(df).first()
    assert s["skewness"] == 0.0 and s["kurtosis"] == 0.0 and s["std"] == 0.0
    params = E.fit_scaler(df, ["c"])
    assert params.std["c"] == 1.0
    assert [r[0] for r in E.apply_scaler(df, params).collect()] == [0.0, 0.0, 0.0]


def test_adjusted_moments_match_pandas(spark):
    import pandas as pd

    vals = [1.0, 2.0, 4.0, 7.0, 11.0, 30.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    s = P.statistical_summary(df).first()
    ser = pd.Series(vals)
    assert abs(s["skewness"] - ser.skew()) < 1e-6
    assert abs(s["kurtosis"] - ser.kurtosis()) < 1e-6
    assert abs(s["p25"] - ser.quantile(0.25)) < 1e-9


def test_population_std_scaler(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    params = E.fit_scaler(df, ["x"])
    assert abs(params.std["x"] - 1.247219) < 1e-6


def test_one_hot_drop_first_and_unseen(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), (None,)], "purpose string")
    levels = E.fit_levels(df, ["purpose"])
    assert levels == {"purpose": ["a", "b", "c"]}
    out = E.apply_one_hot(df, levels)
    assert out.columns == ["purpose_b", "purpose_c"]
    assert [tuple(r) for r in out.collect()] == [(1, 0), (0, 0), (0, 1), (0, 0)]


def test_iqr_strict_bounds(spark):
    rows = [(float(v),) for v in [1, 2, 3, 4, 5, 6, 7, 8, 100]]
    df = spark.createDataFrame(rows, "x double")
    out = P.iqr_outliers(df, exclude=()).collect()
    assert len(out) == 1 and out[0]["outliers"] == 1


def test_null_positions_are_not_duplicates(spark):
    df = spark.createDataFrame([(None, 1), (1, None), (1, None), (None, None)], "a long, b long")
    r = P.duplicate_count(df).first()
    assert (r["duplicate_rows"], r["distinct_rows"]) == (1, 3)
