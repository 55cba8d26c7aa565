"""Inputs outside the fixture: missing labels, constant columns, limits, near ties, hot values."""

import pytest
from pyspark.sql import functions as F

from riskspark.functions.stats import fit_quantiles
from riskspark.operators import decide as D
from riskspark.operators import encode as E
from riskspark.operators import evaluate as EV
from riskspark.operators import split as S
from riskspark.operators import train as T


def test_split_refuses_rows_without_a_label(spark):
    df = spark.range(203).select(F.col("id"), F.when(F.col("id") % 7 != 0, F.col("id") % 2).alias("Default"))
    with pytest.raises(ValueError, match="29 rows have no Default"):
        S.stratified_split(df)


@pytest.mark.parametrize("prefix_len", [1, 2, 4])
def test_split_does_not_depend_on_the_bucket_size(spark, prefix_len):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("Default"))
    got = {r.id: r.split for r in S.stratified_split(df, prefix_len=prefix_len).collect()}
    assert len(got) == 1000 and got == {r.id: r.split for r in S.stratified_split(df, prefix_len=3).collect()}


@pytest.mark.parametrize("value", [1000000.1, 0.1, -3.3])
def test_scaler_of_a_constant_fractional_column(spark, value):
    df = spark.range(10_003).repartition(7).select(F.lit(value).alias("x"))
    p = E.fit_scaler(df, ["x"])
    assert p.std["x"] == 1.0
    assert E.apply_scaler(df, p).agg(F.min("x"), F.max("x")).first() == (0.0, 0.0)


def test_scaler_of_empty_and_null_columns(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert E.fit_scaler(df, ["x"]).std["x"] == 1.0


def test_levels_come_from_a_grouping_with_a_checked_count(spark):
    df = spark.range(50).select((F.col("id") % 4).cast("string").alias("purpose"), F.lit(None).cast("string").alias("home_ownership_n"))
    assert E.fit_levels(df, ["purpose", "home_ownership_n"]) == {"purpose": ["0", "1", "2", "3"], "home_ownership_n": []}
    with pytest.raises(ValueError, match="4 levels exceed 3"):
        E.fit_levels(df, ["purpose"], max_levels=3)


def test_dti_warning_only_for_valid_ratios(spark):
    rows = [(1, 1.5), (2, float("nan")), (3, 0.81), (4, 0.8), (5, 1.0), (6, None), (7, -0.5)]
    df = spark.createDataFrame([(i, 60000.0, 5000.0, 700, d, 3) for i, d in rows],
                               "application_id long, revenue double, loan_amnt double, fico_n int, dti_n double, emp_length_numeric int")
    got = {r.application_id: r.high_dti_warning for r in D.validate(df).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 0, 5: 1, 6: 0, 7: 0}


def test_best_model_is_picked_before_rounding(spark):
    rows = [("a", 1, 0.70000010, 0.1, 0.1, 0.5), ("b", 2, 0.70000049, 0.2, 0.2, 0.5)]
    board = spark.createDataFrame(rows, "model_name string, model_rank int, test_auc double, test_gini double, test_ks double, test_f1 double")
    best = EV.best_model(board).first()
    assert best.best_model == "b" and best.best_auc == 0.7
    assert {r.model_name: r.is_best for r in EV.leaderboard(board).collect()} == {"a": 0, "b": 1}


def test_decision_time_is_utc(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    df = spark.createDataFrame([(1, 60000.0, 5000.0, 700, 0.2, 3)], "application_id long, revenue double, loan_amnt double, fico_n int, dti_n double, emp_length_numeric int")
    from datetime import datetime, timezone

    from riskspark.functions import scorecard as SC
    from riskspark.functions import constants as K

    scaler = E.ScalerParams({c: 0.0 for c in K.NUMERIC_FEATURES}, {c: 1.0 for c in K.NUMERIC_FEATURES})
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        text = D.decisions(df, scaler, SC.COEFFICIENTS, SC.INTERCEPT).first().prediction_timestamp
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert abs((datetime.fromisoformat(text) - datetime.now(timezone.utc).replace(tzinfo=None)).total_seconds()) < 600


def test_quantiles_have_no_single_task_value_map(spark):
    df = spark.range(20_000).select((F.col("id") * 37 % 9973).cast("double").alias("x"), F.lit(2.5).alias("y"))
    got = fit_quantiles(df, ["x", "y"], [0.01, 0.5, 0.99])
    want = df.agg(*[F.percentile(c, F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99))).alias(c) for c in ("x", "y")]).first()
    assert got == {"x": list(want.x), "y": list(want.y)}


def test_first_trees_equal_a_shorter_fit(spark):
    df = spark.range(400).select("id", (F.col("id") * 7 % 13).cast("double").alias("a"), (F.col("id") * 5 % 11).cast("double").alias("b")).withColumn(
        "Default", (F.col("a") + F.col("b") > 12).cast("int"))
    long = T.train_gbt(df, None, ["a", "b"], max_iter=6, max_depth=3)
    short = T.train_gbt(df, None, ["a", "b"], max_iter=4, max_depth=3)
    cut = T.TrainedModel("cut", T.first_trees(long.model, 4), ["a", "b"])
    rows = lambda tm: [round(r.p, 12) for r in T.score(tm, df).orderBy("id").collect()]
    assert cut.model.stages[-1].getNumTrees == 4 and rows(cut) == rows(short)
    assert {r.feature for r in T.feature_importance_table(cut).collect()} == {"a", "b"}


def test_grid_search_returns_the_refitted_model(spark):
    df = spark.range(300).select("id", (F.col("id") * 7 % 13).cast("double").alias("a")).withColumn("Default", (F.col("a") > 6).cast("int"))
    refit = []
    T.tune_logistic(df, ["a"], cs=(0.1, 1.0), max_iter=20, refit=refit)
    weights, _ = T.coefficients(refit[0])
    assert set(weights) == {"a"} and weights["a"] > 0
