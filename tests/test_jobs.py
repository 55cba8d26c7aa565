"""The end-to-end phases run on the smallest tables and leave their outputs on the shared folder."""

import pytest

from riskspark.plans import jobs
from riskspark.session import scratch_path
from riskspark.sources import loans as L
from riskspark.sources import sinks


def test_all_phases(spark, sf_small):
    out = scratch_path(spark, "jobs-test")
    loans = L.loans(spark, sf_small)
    status = jobs.run_all(spark, loans, out, gbt_rounds=3, applications=L.applications(loans))
    assert status["best_model"] in ("Logistic Regression", "Gradient Boosted Trees")
    assert status["is_valid"] is False  # 1,500 rows is below the configured row-count range
    assert spark.read.parquet(f"{out}/tables/engineered").count() > 0
    assert len(spark.read.parquet(f"{out}/tables/engineered").columns) == 45  # key + 43 features + target
    assert spark.read.option("header", True).csv(f"{out}/reports/model_comparison").count() == 2
    assert spark.read.option("header", True).csv(f"{out}/reports/feature_importance").count() == 43
    n_apps = L.applications(loans).count()
    assert spark.read.parquet(f"{out}/tables/decisions").count() + spark.read.parquet(
        f"{out}/tables/rejected").count() == n_apps
    assert "best_model" in spark.read.json(f"{out}/metadata/models").first()["record"]
    info = jobs.model_info(spark, out).first()
    assert (info["model_name"], info["version"], info["algorithm"]) == ("Credit Default Risk Predictor", "1.0.0", status["best_model"])
    assert info["features_count"] == 44 and info["from_metadata"]  # 43 features and the target
    assert set(info["performance_metrics"]) == {"auc_roc", "gini", "ks_statistic"}
    # phases alone, from what the others left: the stored model and scaler give the same decisions
    want = spark.read.parquet(f"{out}/tables/decisions").drop("prediction_timestamp").orderBy("application_id").toPandas()
    jobs.run_phase(spark, "score", out, lambda: loans)
    got = spark.read.parquet(f"{out}/tables/decisions").drop("prediction_timestamp").orderBy("application_id").toPandas()
    assert got.equals(want)
    jobs.run_phase(spark, "explain", out, lambda: loans)
    assert spark.read.option("header", True).csv(f"{out}/reports/feature_importance").count() == 43


def test_model_info_without_model_metadata(spark):
    out = scratch_path(spark, "info-test")
    with pytest.raises(ValueError, match="features phase"):
        jobs.model_info(spark, out)
    sinks.write_metadata_json(sinks.metadata_record(spark, {"all_features": ["a", "b"]}), f"{out}/metadata/features")
    info = jobs.model_info(spark, out).first()
    assert (info["version"], info["training_date"], info["features_count"], info["algorithm"]) == ("1.0.0", "2024-12-01", 2, None)
    assert info["performance_metrics"]["gini"] == 0.562 and not info["from_metadata"]
