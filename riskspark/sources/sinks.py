"""Sinks (S4-S8): tables, small reports, metadata records, fitted models.

Every path is on shared storage; small reports are written by one task on
purpose (``coalesce(1)``) because they are a handful of rows -- never a
table that grows with the data.
"""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """The cleaned / engineered table hand-over as Parquet (optionally partitioned, e.g. by issue_year)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_partitions(df: DataFrame, path: str, by: str) -> None:
    """Write or rewrite the partitions that ``df`` holds and leave the others; a partition's rows are spread over files of
    even size before the write (rebalance), so a partition is neither one huge file nor many tiny ones."""
    (df.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path))


def write_report_csv(df: DataFrame, path: str) -> None:
    """A report (a row per column, model or feature) as one CSV file with a header; the plan runs once."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_metadata_json(df: DataFrame, path: str) -> None:
    """A metadata record (one row, nested allowed) as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def metadata_record(spark: SparkSession, record: dict) -> DataFrame:
    """A driver-side dict (fitted parameters, split sizes) as a one-row DataFrame with a JSON column."""
    return spark.createDataFrame([(json.dumps(record, sort_keys=True, default=str),)], "record string").select(
        F.col("record"))


def read_metadata_json(spark: SparkSession, path: str) -> DataFrame:
    """Read a metadata record back."""
    return spark.read.json(path)


def read_record(spark: SparkSession, path: str) -> dict:
    """A dict written by ``metadata_record``; empty where there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return {}
    return json.loads(read_metadata_json(spark, path).first()["record"])


def save_model(model: PipelineModel, path: str) -> None:
    """Model persistence in MLlib's own format (metadata JSON + Parquet node/coef tables)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
