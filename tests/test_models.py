"""Model store: fit once, later calls load the same model; any change of inputs or parameters refits."""

from riskspark.operators import train as T
from riskspark.plans import models as M


def test_fit_once_then_load(spark, sf_small):
    from riskspark.plans.catalog import _model_split, loans

    sp, feats = _model_split(spark, sf_small)
    train_df = sp.filter("split = 'train'")
    calls = []

    def fit():
        calls.append(1)
        return T.train_logistic(train_df, feats, max_iter=50)

    src = loans(spark, sf_small)
    first = M.fit_or_load(spark, src, "lr-test", {"max_iter": 50}, feats, fit)
    second = M.fit_or_load(spark, src, "lr-test", {"max_iter": 50}, feats, fit)
    assert len(calls) == 1
    assert "loaded_from" in second.info and second.features == feats
    assert list(second.model.stages[-1].coefficients) == list(first.model.stages[-1].coefficients)
    # a different parameter set is a different entry
    M.fit_or_load(spark, src, "lr-test", {"max_iter": 51}, feats, fit)
    assert len(calls) == 2


def test_key_tracks_inputs_and_params(spark, sf_small):
    a = spark.read.parquet(f"{sf_small}/orders.parquet")
    b = spark.read.parquet(f"{sf_small}/customer.parquet")
    k = M.model_key(spark, a, "gbt", {"r": 1}, ["x"])
    assert k == M.model_key(spark, a, "gbt", {"r": 1}, ["x"])
    assert k != M.model_key(spark, b, "gbt", {"r": 1}, ["x"])
    assert k != M.model_key(spark, a, "gbt", {"r": 2}, ["x"])
    assert k != M.model_key(spark, a, "gbt", {"r": 1}, ["x", "y"])


def test_rewritten_input_changes_key(spark):
    from riskspark.session import scratch_path

    path = scratch_path(spark, "store-key")
    spark.range(10).write.mode("overwrite").parquet(path)
    k1 = M.model_key(spark, spark.read.parquet(path), "lr", {}, ["id"])
    assert k1 == M.model_key(spark, spark.read.parquet(path), "lr", {}, ["id"])
    spark.range(20).write.mode("overwrite").parquet(path)  # same path, new content
    assert k1 != M.model_key(spark, spark.read.parquet(path), "lr", {}, ["id"])


def test_stored_model_needs_no_pipeline(spark, sf_small, monkeypatch):
    from riskspark.plans import catalog

    first = catalog.q_train_lr(spark, sf_small).collect()

    def fail(*_):
        raise AssertionError("the feature pipeline ran")

    monkeypatch.setattr(catalog, "_model_split", fail)
    assert catalog.q_train_lr(spark, sf_small).collect() == first
