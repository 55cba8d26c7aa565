"""The engineered-table pipeline: 43 columns in manifest order; fit_on='train' avoids leakage."""

from pyspark.sql import functions as F

from riskspark.operators import features as FE
from riskspark.operators.split import stratified_split
from riskspark.plans import catalog as C
from riskspark.plans import pipeline as PL

MANIFEST_TAIL = ["purpose_credit_card", "purpose_debt_consolidation", "purpose_educational",
                 "purpose_home_improvement", "purpose_house", "purpose_major_purchase", "purpose_medical",
                 "purpose_moving", "purpose_other", "purpose_renewable_energy", "purpose_small_business",
                 "purpose_vacation", "purpose_wedding", "home_ownership_n_OTHER", "home_ownership_n_OWN",
                 "home_ownership_n_RENT", "income_bracket_25K-50K", "income_bracket_50K-75K",
                 "income_bracket_75K-100K", "income_bracket_>100K", "fico_bracket_Fair", "fico_bracket_Good",
                 "fico_bracket_Very Good", "fico_bracket_Excellent"]


def test_manifest_order(spark, sf_small):
    eng, _ = PL.engineered(C.loans(spark, sf_small))
    cols = PL.model_columns(eng)
    assert len(cols) == 43
    assert cols[-24:] == MANIFEST_TAIL
    assert eng.columns[0] == "id" and eng.columns[20] == "Default"


def test_fit_on_train_uses_training_rows_only(spark, sf_small):
    loans = C.loans(spark, sf_small)
    all_fit, clean_all = PL.fit(loans, fit_on="all")
    train_fit, clean_train = PL.fit(loans, fit_on="train")
    assert clean_all.count() == clean_train.count()  # the transform still covers every row
    assert all_fit.levels == train_fit.levels
    assert all_fit.scaler.mean["revenue"] != train_fit.scaler.mean["revenue"]
    # the winsor bounds are the training rows' percentiles
    am = PL.C.apply_missing(*PL.C.fit_missing_once(loans, "t"))
    train_rows = stratified_split(am).filter(F.col("split") == "train")
    p = train_rows.agg(F.percentile("fico_n", F.lit(0.99))).first()[0]
    assert train_fit.winsor.bounds["fico_n"][1] == p


def test_profile_facade(spark):
    apps = spark.createDataFrame([(1, 50000.0, 1000.0, 700, 0.2, 5)],
                                 "application_id long, revenue double, loan_amnt double, fico_n int, dti_n double, "
                                 "emp_length_numeric int")
    assert len(FE.features(apps, profile="serving").columns) == 44
