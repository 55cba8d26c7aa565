"""Feature expressions on literal edge frames (FIXTURES.md section 5)."""

from pyspark.sql import functions as F

from riskspark.operators import features as FE


def _one(spark, rows, schema, exprs):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[e.alias(k) for k, e in exprs(df).items()]).collect()]


def test_income_bracket_right_closed(spark):
    rows = [(0.0,), (1.0,), (25000.0,), (25000.01,), (50000.0,), (75000.0,), (100000.0,), (100000.01,)]
    df = spark.createDataFrame(rows, "revenue double")
    got = [r[0] for r in df.select(FE.financial_ratios(df)["income_bracket"]).collect()]
    assert got == [None, "<25K", "<25K", "25K-50K", "25K-50K", "50K-75K", "75K-100K", ">100K"]


def test_fico_bracket_right_closed(spark):
    vals = [0, 580, 581, 670, 740, 800, 801, 900, 901]
    df = spark.createDataFrame([(float(v),) for v in vals], "fico_n double")
    got = [r[0] for r in df.select(FE.credit_score_features(df)["fico_bracket"]).collect()]
    assert got == [None, "Poor", "Fair", "Fair", "Good", "Very Good", "Excellent", "Excellent", None]


def test_loan_to_income_guard_and_cap(spark):
    df = spark.createDataFrame([(0.0, 100.0), (5.0, 100.0), (1000.0, 100.0)], "revenue double, loan_amnt double")
    got = [r[0] for r in df.select(FE.financial_ratios(df)["loan_to_income"]).collect()]
    assert got == [0.0, 10.0, 0.1]


def test_employment_text_map(spark):
    df = spark.createDataFrame([("< 1 year",), ("10+ years",), ("n/a",), ("weird",), (None,), ("3 years",)],
                               "emp_length string")
    e = FE.employment_features(df)
    got = [tuple(r) for r in df.select(e["emp_length_numeric"], e["employment_stable"]).collect()]
    assert got == [(0, 0), (10, 1), (0, 0), (0, 0), (0, 0), (3, 1)]


def test_date_parts_multiple_formats_and_bad_text(spark):
    df = spark.createDataFrame([("2015-12-01",), ("Dec-2015",), ("garbage",)], "issue_d string")
    e = FE.temporal_features(df)
    got = [tuple(r) for r in df.select(e["issue_year"], e["issue_month"], e["issue_quarter"]).collect()]
    assert got == [(2015, 12, 4), (2015, 12, 4), (None, None, None)]


def test_interaction_flags_null_safe(spark):
    df = spark.createDataFrame([(30.0, 20000.0, 30000.0, 600.0), (None, 20000.0, None, None)],
                               "dti_n double, revenue double, loan_amnt double, fico_n double")
    cuts = FE.InteractionCuts(dti_p75=20.0, loan_p75=25000.0, fico_p25=650.0)
    e = FE.interaction_features(df, cuts)
    got = [tuple(r) for r in df.select(e["high_debt_low_income"], e["high_loan_low_fico"]).collect()]
    assert got == [(1, 1), (0, 0)]


def test_serving_profile_bins_are_left_closed(spark):
    apps = spark.createDataFrame([(1, 25000.0, 100.0, 670, 0.2, 5), (2, 24999.0, 100.0, 669, 0.2, 5)],
                                 "application_id long, revenue double, loan_amnt double, fico_n int, "
                                 "dti_n double, emp_length_numeric int")
    out = FE.serving_features(apps).orderBy("application_id").collect()
    assert out[0]["income_bracket_25K-50K"] == 1.0 and out[0]["fico_bracket_Good"] == 1.0
    assert out[1]["income_bracket_25K-50K"] == 0.0 and out[1]["fico_bracket_Good"] == 0.0
    assert out[0]["fico_bracket_Fair"] == 0.0  # the serving profile never sets Fair
    assert len(out[0]) == 44  # key + 43 features
    assert out[0]["dti_n"] == 20.0 and out[0]["DTI_ratio"] == 0.2
