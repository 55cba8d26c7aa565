"""Scoring as a Structured Streaming job.

Applications arrive as files (or any streaming source with the application
schema); each micro-batch is validated, split into valid / rejected, and the
valid rows go through the same narrow decision plan as the batch job. The
plan is stateless -- no watermark, no state store -- so the only state is the
source offsets in the checkpoint.

Exactly-once: ``foreachBatch`` writes each epoch into its own
``_epoch=<id>`` directory with overwrite, so a replayed epoch after a failure
rewrites the same files instead of appending duplicates.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskspark.operators import decide as D
from riskspark.operators.encode import ScalerParams
from riskspark.sources.loans import APPLICATION_SCHEMA


def application_stream(spark: SparkSession, source_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """The files of ``source_dir`` as a stream; ``files_per_trigger`` bounds a micro-batch (default: unbounded)."""
    reader = spark.readStream.schema(APPLICATION_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(source_dir)


def start(stream: DataFrame, scaler: ScalerParams, coefficients: Mapping[str, float], intercept: float,
          decisions_path: str, rejected_path: str, checkpoint: str, available_now: bool = True,
          with_timestamp: bool = True) -> StreamingQuery:
    """Run the decision plan over a stream; decisions and rejects go to two Parquet tables."""

    def each_batch(batch: DataFrame, epoch_id: int) -> None:
        checked = D.validate(batch).persist()
        try:
            valid = checked.filter(F.col("is_valid") == 1).drop("errors", "is_valid", "high_dti_warning")
            out = D.decisions(valid, scaler, coefficients, intercept, with_timestamp=with_timestamp)
            out.write.mode("overwrite").parquet(f"{decisions_path}/_epoch={epoch_id}")
            rej = checked.filter(F.col("is_valid") == 0).select(
                "application_id", F.size("errors").alias("n_errors"), F.concat_ws("; ", "errors").alias("details"))
            rej.write.mode("overwrite").parquet(f"{rejected_path}/_epoch={epoch_id}")
        finally:
            checked.unpersist()

    writer = stream.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
