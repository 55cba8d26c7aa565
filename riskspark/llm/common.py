"""Helpers shared by the operators: reading tables, scratch tables, Arrow batches, components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.session import materialize, ship_package
from riskspark.sources.tables import read_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return read_table(spark, sf_dir, name, columns or None)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    return materialize(df, f"llm-{name}")


def with_python(df: DataFrame) -> DataFrame:
    """Call before a Python stage: executors must be able to import this package."""
    ship_package(df.sparkSession)
    return df


def ascii_lower(column):
    """A-Z to a-z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def raw_strings(array: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column without decoding it."""
    return array.cast(pa.binary()).to_pylist()


def chunked(rows: Iterable[tuple], schema: pa.Schema, max_rows: int = 4096, max_bytes: int = 8 << 20,
            weigh=None) -> Iterator[pa.RecordBatch]:
    """Row tuples to record batches of a bounded number of rows and (by ``weigh``) bytes."""
    buf: list[tuple] = []
    size = 0
    for r in rows:
        buf.append(r)
        size += weigh(r) if weigh else 0
        if len(buf) >= max_rows or size >= max_bytes:
            yield to_batch(buf, schema)
            buf, size = [], 0
    if buf:
        yield to_batch(buf, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``links`` (a, b: long). Returns (node, root): root is the smallest
    node of the component; a node without a link to another node has no row.

    Alternating large-star and small-star rounds. A hub costs one aggregate row per neighbour (the
    minimum is combined before the shuffle, and the join on the hub can be split), never a group in
    memory. Ends when a round changes nothing; each round is written to the shared folder.
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        edges = stage(small.where("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError("components did not settle")
