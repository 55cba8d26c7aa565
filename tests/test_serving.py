"""Published artifacts and the serving stream: atomic versions, model refresh, repeated applications."""

import pytest
from pyspark.sql import functions as F

from riskspark.functions import scorecard as SC
from riskspark.operators.encode import ScalerParams
from riskspark.operators.newton import LinearModel
from riskspark.plans import artifacts as AR
from riskspark.plans import catalog as C
from riskspark.plans import pipeline as PL
from riskspark.session import scratch_path
from riskspark.sources.loans import APPLICATION_SCHEMA
from riskspark.streaming import decisions as STR
from riskspark.streaming import serving as SV


def test_versions_are_whole_and_the_last_one_wins(spark):
    folder = scratch_path(spark, "artifact")
    assert AR.read(spark, folder) is None
    a = AR.publish(spark, folder, {"x": 1})
    assert AR.read(spark, folder) == {"x": 1}
    # a second writer dies before it renames: the first version stays in use
    AR.M._write_text(spark, f"{folder}/dead.json", "{\"x\"")
    AR.M._write_text(spark, f"{folder}/_dead", "dead")
    assert AR.read(spark, folder) == {"x": 1}
    b = AR.publish(spark, folder, {"x": 2})
    assert AR.current_version(spark, folder) == b and AR.read(spark, folder, a) == {"x": 1} and AR.read(spark, folder) == {"x": 2}


def test_scoring_reads_what_was_published_and_fits_nothing(spark, sf_small, monkeypatch):
    want = C.q_decisions(spark, sf_small).orderBy("application_id").collect()

    def fail(*_a, **_k):
        raise AssertionError("a fit ran")

    monkeypatch.setattr(PL, "fit", fail)
    assert C.q_decisions(spark, sf_small).orderBy("application_id").collect() == want
    again = AR.pipeline_of(AR.pipeline_payload(C.stored_pipeline(spark, sf_small)))
    assert again == C.stored_pipeline(spark, sf_small)


def test_stored_pipeline_gives_the_fitted_table(spark, sf_small):
    stored, fitted = C.stored_engineered(spark, sf_small), C.engineered(spark, sf_small)
    assert stored.columns == fitted.columns
    a, b = (df.orderBy("id").toPandas() for df in (stored, fitted))
    assert a.shape == b.shape and ((a - b).abs().max() < 1e-9).all()


def apps(spark, ids):
    rows = [(i, 50000.0 + (i or 0), 10000.0, 700, 0.2, 5) for i in ids]
    return spark.createDataFrame(rows, APPLICATION_SCHEMA)


def test_refresh_without_restart_and_each_application_once(spark):
    base = scratch_path(spark, "serving-test")
    zero = ScalerParams({}, {})
    low, high = (LinearModel("m", [], [], b) for b in (-4.0, 4.0))
    with pytest.raises(ValueError, match="no model is published"):
        SV.published_model(spark, f"{base}/model")
    v1 = SV.publish_model(spark, f"{base}/model", low, zero)
    apps(spark, [1, 2, None]).write.parquet(f"{base}/in")
    q = SV.start_serving(STR.application_stream(spark, f"{base}/in"), f"{base}/model", f"{base}/dec", f"{base}/rej", f"{base}/ck", available_now=False, with_timestamp=False)
    q.processAllAvailable()
    v2 = SV.publish_model(spark, f"{base}/model", high, zero)
    apps(spark, [2, 3]).write.mode("append").parquet(f"{base}/in")
    q.processAllAvailable()
    q.stop()
    # the same checkpoint after a restart still knows who was decided
    apps(spark, [1, 3, 4, 4]).write.mode("append").parquet(f"{base}/in")
    SV.start_serving(STR.application_stream(spark, f"{base}/in"), f"{base}/model", f"{base}/dec", f"{base}/rej", f"{base}/ck", with_timestamp=False).awaitTermination()
    got = sorted((r["application_id"] or 0, r["model_version"], r["risk_category"]) for r in spark.read.parquet(f"{base}/dec").collect())
    assert got == sorted([(1, v1, "Low Risk"), (2, v1, "Low Risk"), (0, v1, "Low Risk"), (3, v2, "High Risk"), (4, v2, "High Risk")])


def test_decisions_of_the_best_model_have_no_python(spark, sf_small):
    """The boosted trees score as a column expression over the serving features."""
    from riskspark.operators import boost as B
    from riskspark.operators import decide as D

    df = C.stored_engineered(spark, sf_small)
    feats = PL.model_columns(df)
    m = B.fit_boosted(df, None, feats, rounds=2, depth=2)
    a, sc = C.served(spark, sf_small)
    out = D.decide(a, sc, B.probability(m), with_timestamp=False)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert out.count() == C.q_decisions(spark, sf_small).count() and out.where(F.col("probability_of_default").isNull()).count() == 0
    assert SC.COEFFICIENTS.keys() <= set(feats)
