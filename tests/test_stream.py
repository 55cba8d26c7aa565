"""The streaming job produces exactly the batch decisions."""

from pyspark.sql import functions as F

from riskspark.functions import scorecard as SC
from riskspark.operators import decide as D
from riskspark.plans import catalog as C
from riskspark.session import scratch_path
from riskspark.streaming import decisions as STR


def test_stream_equals_batch(spark, sf_small):
    apps = C.applications(spark, sf_small)
    scaler = C.scaler(spark, sf_small)
    base = scratch_path(spark, "stream-test")
    apps.repartition(4).write.parquet(f"{base}/in")
    q = STR.start(STR.application_stream(spark, f"{base}/in", files_per_trigger=1), scaler, SC.COEFFICIENTS,
                  SC.INTERCEPT, f"{base}/dec", f"{base}/rej", f"{base}/ck", with_timestamp=False)
    q.awaitTermination()
    streamed = spark.read.parquet(f"{base}/dec").drop("_epoch").withColumn("risk_factors", F.concat_ws("|", "risk_factors"))
    batch = D.decisions(apps, scaler, SC.COEFFICIENTS, SC.INTERCEPT, with_timestamp=False).withColumn(
        "risk_factors", F.concat_ws("|", "risk_factors"))
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
    rejected = spark.read.parquet(f"{base}/rej")
    assert rejected.count() + streamed.count() == apps.count()


def test_sinks_roundtrip(spark):
    from riskspark.operators import train as T
    from riskspark.sources import sinks

    base = scratch_path(spark, "sinks-test")
    df = spark.createDataFrame([(1, 0.5, 2020), (2, 0.7, 2021)], "id long, x double, issue_year int")
    sinks.write_table(df, f"{base}/t", partition_by=["issue_year"])
    assert spark.read.parquet(f"{base}/t").count() == 2
    sinks.write_report_csv(df, f"{base}/r")
    assert spark.read.option("header", True).csv(f"{base}/r").count() == 2
    sinks.write_metadata_json(sinks.metadata_record(spark, {"n": 2, "cols": ["id", "x"]}), f"{base}/m")
    assert sinks.read_metadata_json(spark, f"{base}/m").first()["record"] == '{"cols": ["id", "x"], "n": 2}'
    data = spark.createDataFrame([(i, float(i % 5), i % 2) for i in range(60)], "id long, a double, Default long")
    tm = T.train_logistic(data, ["a"], max_iter=20)
    sinks.save_model(tm.model, f"{base}/model")
    again = sinks.load_model(f"{base}/model")
    a = [r.prediction for r in tm.model.transform(data.withColumn("label", F.col("Default").cast("double"))).collect()]
    b = [r.prediction for r in again.transform(data.withColumn("label", F.col("Default").cast("double"))).collect()]
    assert a == b


def test_stream_restart_is_idempotent(spark, sf_small):
    apps = C.applications(spark, sf_small)
    scaler = C.scaler(spark, sf_small)
    base = scratch_path(spark, "stream-restart")
    apps.repartition(2).write.parquet(f"{base}/in")
    for _ in range(2):  # the second run finds every file committed in the checkpoint
        q = STR.start(STR.application_stream(spark, f"{base}/in"), scaler, SC.COEFFICIENTS, SC.INTERCEPT,
                      f"{base}/dec", f"{base}/rej", f"{base}/ck", with_timestamp=False)
        q.awaitTermination()
    dec = spark.read.parquet(f"{base}/dec")
    assert dec.count() == dec.select("application_id").distinct().count()
