"""D14 with model refresh and repeated applications.

Every micro-batch looks up the published artifact (scaler and model, ``plans.artifacts``), so a newly published model
decides from the next batch on, without a restart. An application that arrives again is decided once: the state store keeps
its key for ``remember`` (a watermark on the time of arrival bounds the state), across batches and restarts of the same
checkpoint. Rows without an application id are told apart by their content.

Each epoch is written to a folder of its own with overwrite, so a replayed epoch can't add rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskspark.functions.columns import col
from riskspark.operators import decide as D
from riskspark.operators.boost import BoostedModel
from riskspark.operators.encode import ScalerParams
from riskspark.operators.newton import LinearModel
from riskspark.operators.train import probability_of
from riskspark.plans import artifacts


def publish_model(spark: SparkSession, folder: str, model: LinearModel | BoostedModel, scaler: ScalerParams) -> str:
    """Make ``model`` with ``scaler`` the one that serving uses; returns its version."""
    kind = "linear" if isinstance(model, LinearModel) else "boosted"
    return artifacts.publish(spark, folder, {"kind": kind, "model": model.to_json(), "scaler": {"mean": scaler.mean, "std": scaler.std}})


def published_model(spark: SparkSession, folder: str):
    """(version, model, scaler) in use."""
    version = artifacts.current_version(spark, folder)
    if version is None:
        raise ValueError(f"no model is published under {folder}")
    found = artifacts.read(spark, folder, version)
    model = (LinearModel if found["kind"] == "linear" else BoostedModel).from_json(found["model"])
    return version, model, ScalerParams(**found["scaler"])


def once_each(stream: DataFrame, remember: str = "7 days", key: str = "application_id") -> DataFrame:
    """The stream without applications whose id arrived before, within ``remember``."""
    own = F.coalesce(col(key).cast("string"), F.concat(F.lit("row "), F.xxhash64(*[col(c) for c in stream.columns]).cast("string")))
    seen = stream.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", remember).withColumn("_key", own)
    return seen.dropDuplicatesWithinWatermark(["_key"]).select(*[col(c) for c in stream.columns])


def start_serving(stream: DataFrame, folder: str, decisions_path: str, rejected_path: str, checkpoint: str, remember: str = "7 days",
                  available_now: bool = True, with_timestamp: bool = True) -> StreamingQuery:
    """Decide the applications of a stream with the model published under ``folder`` at the time of each batch."""

    def each_batch(batch: DataFrame, epoch_id: int) -> None:
        version, model, scaler = published_model(batch.sparkSession, folder)
        checked = batch.persist()
        try:
            out = D.decide(checked, scaler, probability_of(model), with_timestamp=with_timestamp).withColumn("model_version", F.lit(version))
            out.write.mode("overwrite").parquet(f"{decisions_path}/_epoch={epoch_id}")
            D.rejected(checked).write.mode("overwrite").parquet(f"{rejected_path}/_epoch={epoch_id}")
        finally:
            checked.unpersist()

    writer = once_each(stream, remember).writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")
    return writer.start()
