"""S1 with a quarantine: a CSV scan that gives good rows, rejected rows with reasons, and counts.

A permissive typed scan turns what it can't read into NULLs without a word. Here every field is read as text; a row
with too few or too many fields, or with text where a number belongs, goes to the rejects with its line; NA tokens are
missing values, not errors. Dates that no known format reads stay in the row (they become NULL later, as before) and are
counted. All of it is one narrow pass over the file.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.functions.columns import col
from riskspark.operators.features import parse_date
from riskspark.sources.loans import LOAN_SCHEMA, NA_TOKENS

_LINE = "_line"


@dataclass
class CsvScan:
    """``rows``: typed good rows; ``rejects``: (line, reasons); ``marked``: every row as text with its reasons."""

    rows: DataFrame
    rejects: DataFrame
    marked: DataFrame
    schema: T.StructType

    def counts(self, dates: Sequence[str] = ("issue_d",)) -> DataFrame:
        """One row: rows, good_rows, rejected_rows, wrong_fields, unparsed_numbers, unparsed_dates (in good rows)."""
        bad = F.size("_reasons") > 0
        unread = F.lit(0)
        for c in dates:
            unread = unread + F.when(~bad & col(c).isNotNull() & parse_date(col(c)).isNull(), 1).otherwise(0)
        number = F.size(F.filter("_reasons", lambda r: r.startswith("not a number: ")))
        return self.marked.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~bad).alias("good_rows"), F.count_if(bad).alias("rejected_rows"),
                               F.count_if(F.array_contains("_reasons", "wrong number of fields")).alias("wrong_fields"),
                               F.coalesce(F.sum(number), F.lit(0)).cast("long").alias("unparsed_numbers"), F.coalesce(F.sum(unread), F.lit(0)).cast("long").alias("unparsed_dates"))


def check_header(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """The file's header must name the schema's columns in their order; tells what is missing, unknown or out of place."""
    found, wanted = spark.read.option("header", True).csv(path).columns, schema.names
    if found == wanted:
        return
    missing, extra = [c for c in wanted if c not in found], [c for c in found if c not in wanted]
    what = [f"missing columns: {', '.join(missing)}"] * bool(missing) + [f"unknown columns: {', '.join(extra)}"] * bool(extra)
    raise ValueError("; ".join(what or [f"columns in another order: {', '.join(found)}"]))


def scan_csv(spark: SparkSession, path: str, schema: T.StructType = LOAN_SCHEMA, na_tokens: list[str] | None = None) -> CsvScan:
    """Scan a CSV file or folder (with header) into good rows and rejects. A header that differs is an error."""
    check_header(spark, path, schema)
    tokens = NA_TOKENS if na_tokens is None else na_tokens
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields] + [T.StructField(_LINE, T.StringType())])
    raw = (spark.read.schema(text).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _LINE)
           .option("columnPruning", False).option("nullValue", "").csv(path))
    known = [F.when(col(f.name).isin(tokens), F.lit(None)).otherwise(col(f.name)).alias(f.name) for f in schema.fields]
    clean = raw.select(*known, F.col(_LINE))
    numeric = [f for f in schema.fields if isinstance(f.dataType, T.NumericType)]
    unread = [F.when(F.col(_LINE).isNull() & col(f.name).isNotNull() & F.trim(col(f.name)).try_cast(f.dataType).isNull(), F.lit(f"not a number: {f.name}")) for f in numeric]
    reasons = F.array_compact(F.array(F.when(F.col(_LINE).isNotNull(), F.lit("wrong number of fields")), *unread))
    marked = clean.withColumn("_reasons", reasons)
    line = F.coalesce(F.col(_LINE), F.to_csv(F.struct(*[col(c) for c in schema.names])))
    typed = [(F.trim(col(f.name)).try_cast(f.dataType) if isinstance(f.dataType, T.NumericType) else col(f.name)) for f in schema.fields]
    nan_free = [(F.nanvl(c, F.lit(None).cast(f.dataType)) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c).alias(f.name) for c, f in zip(typed, schema.fields)]
    good = marked.where(F.size("_reasons") == 0).select(*nan_free)
    rejects = marked.where(F.size("_reasons") > 0).select(line.alias("line"), F.col("_reasons").alias("reasons"))
    return CsvScan(good, rejects, marked, schema)
