"""Profile of a growing table (Q8-Q12) from mergeable parts per file: only new files are read.

For every data file one row is kept: rows, non-null counts, positives of the target, a HyperLogLog sketch of each column and of the
whole rows, and a digest of the rows as a multiset (sum of row hashes). An update lists the files (Spark does, without
contents), reads those that aren't known by (path, length, modification time), appends their rows to the store and leaves out files
that are gone. The report merges the parts: counts and digests add up, sketches unite. Equal to a profile of all files at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.functions import constants as K
from riskspark.functions.columns import col
from riskspark.session import materialize


@dataclass
class Update:
    files_known: int
    files_read: int
    files_gone: int


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.unix_micros("modificationTime").alias("modified"))


def file_profiles(df: DataFrame, columns: list[str], target: str = K.TARGET) -> DataFrame:
    """One row per file of ``df`` (a scan with its ``_metadata`` column): counts and sketches."""
    row = [col(c) for c in columns]
    whole = F.xxhash64(*row, F.concat_ws("", *[c.isNull().cast("int").cast("string") for c in row]))
    aggs = [F.count(F.lit(1)).alias("rows"), F.sum(whole.cast("decimal(38,0)")).alias("digest"), F.hll_sketch_agg(whole).alias("distinct_rows")]
    aggs.append(F.count_if(col(target) == 1).alias("positives") if target in columns else F.lit(0).cast("long").alias("positives"))
    for i, c in enumerate(columns):
        aggs += [F.count(col(c)).alias(f"n{i}"), F.hll_sketch_agg(col(c).cast("string")).alias(f"d{i}")]
    of = df.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"), F.unix_micros("_metadata.file_modification_time").alias("modified"))
    return of.groupBy("path", "length", "modified").agg(*aggs)


def update(spark: SparkSession, path: str, store: str, columns: list[str], target: str = K.TARGET) -> Update:
    """Bring the store up to date with the Parquet files below ``path``."""
    now = materialize(_files(spark, path), "files-now")
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    known = spark.read.parquet(store) if jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path) else None
    keys = ["path", "length", "modified"]
    fresh = now if known is None else now.join(known.select(*keys), keys, "left_anti")
    # a scan names its files, so the names of new files alone pass the driver: a bounded batch at a time
    read = 0
    held = set() if known is None else {0}
    for batch in _batches([r["path"] for r in fresh.select("path").toLocalIterator()]):
        part = file_profiles(spark.read.parquet(*batch).select(*[col(c) for c in columns], "_metadata"), columns, target)
        part.write.mode("append" if held or read else "overwrite").parquet(store)
        read += len(batch)
    total = now.count()
    gone = 0 if known is None else known.join(now, keys, "left_anti").count()
    return Update(total - read, read, gone)


def _batches(items, size: int = 10_000):
    for at in range(0, len(items), size):
        yield items[at:at + size]


def merged_profile(spark: SparkSession, path: str, store: str, columns: list[str]) -> DataFrame:
    """(column_name, rows, non_null, distinct_estimate, positives, digest) over the files that are below ``path`` now."""
    keys = ["path", "length", "modified"]
    parts = spark.read.parquet(store).dropDuplicates(keys).join(_files(spark, path), keys, "left_semi")
    wide = parts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sum("digest").alias("digest"), F.coalesce(F.sum("positives"), F.lit(0)).alias("positives"),
                     *[a for i in range(len(columns)) for a in (F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}"), F.hll_sketch_estimate(F.hll_union_agg(f"d{i}")).alias(f"d{i}"))])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("rows"), F.col(f"n{i}").alias("non_null"), F.col(f"d{i}").alias("distinct_estimate"),
                                                    F.col("positives"), F.col("digest")) for i, c in enumerate(columns)])))
