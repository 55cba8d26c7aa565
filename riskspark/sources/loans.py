"""The loan book: declared schema, CSV scan with NA tokens, and the ``loans`` /
``applications`` views derived from the given TPC-H-style tables.

The driver tables hold no loans, so ``loans`` is a deterministic projection of
``orders x customer x nation`` plus the per-order quantity of ``lineitem`` that
carries the loan schema, its null pattern and its edge values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.sources.tables import read_table

LOAN_COLUMNS = [
    "id", "issue_d", "revenue", "dti_n", "loan_amnt", "fico_n", "experience_c", "emp_length",
    "purpose", "home_ownership_n", "addr_state", "zip_code", "Default", "title", "desc",
]

LOAN_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("issue_d", T.StringType()),
    T.StructField("revenue", T.DoubleType()),
    T.StructField("dti_n", T.DoubleType()),
    T.StructField("loan_amnt", T.LongType()),
    T.StructField("fico_n", T.DoubleType()),
    T.StructField("experience_c", T.LongType()),
    T.StructField("emp_length", T.StringType()),
    T.StructField("purpose", T.StringType()),
    T.StructField("home_ownership_n", T.StringType()),
    T.StructField("addr_state", T.StringType()),
    T.StructField("zip_code", T.StringType()),
    T.StructField("Default", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("desc", T.StringType()),
])

APPLICATION_SCHEMA = T.StructType([
    T.StructField("application_id", T.LongType()),
    T.StructField("revenue", T.DoubleType()),
    T.StructField("loan_amnt", T.DoubleType()),
    T.StructField("fico_n", T.IntegerType()),
    T.StructField("dti_n", T.DoubleType()),
    T.StructField("emp_length_numeric", T.IntegerType()),
])

# The text tokens a default CSV read treats as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Fixed values of the fixture mapping (FIXTURES.md section 2), in index order.
FIXTURE_EMP_LENGTH = [
    "< 1 year", "1 year", "2 years", "3 years", "4 years", "5 years", "6 years", "7 years",
    "8 years", "9 years", "10+ years", "n/a", "NI",
]
FIXTURE_PURPOSE = [
    "car", "credit_card", "debt_consolidation", "educational", "home_improvement", "house",
    "major_purchase", "medical", "moving", "other", "renewable_energy", "small_business",
    "vacation", "wedding",
]


def _pick(labels: list[str], index: Column) -> Column:
    """labels[index] for a 0-based integer column (index is always in range)."""
    return F.element_at(F.array(*[F.lit(x) for x in labels]), (index + 1).cast("int"))


def _calendar_date(df: DataFrame, name: str) -> Column:
    """The stored wall-clock date of a timestamp column, whatever the session time zone.

    Parquet timestamps without a zone read as TIMESTAMP_NTZ (cast is zone-free);
    if a session reads them as zone-aware instead, take the UTC day number.
    """
    dt = df.schema[name].dataType
    if isinstance(dt, T.TimestampType):
        return F.date_from_unix_date(F.floor(F.unix_micros(F.col(name)) / F.lit(86_400_000_000)).cast("int"))
    return F.col(name).cast("date")


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``loans`` view (FIXTURES.md section 2) as a DataFrame plan.

    Plan shape: lineitem is pre-aggregated per order (partial aggregation
    before the shuffle), orders join customer on the customer key, nation
    (25 rows by definition of the schema) is broadcast, the per-order
    quantity joins on the order key. Only the needed columns are scanned.
    """
    li = (
        read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_quantity"])
        .groupBy("l_orderkey")
        .agg(F.sum("l_quantity").alias("qty"))
    )
    orders = read_table(spark, sf_dir, "orders",
                        ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"])
    customer = read_table(spark, sf_dir, "customer",
                          ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])

    base = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    )
    ok, ck = F.col("o_orderkey"), F.col("c_custkey")
    fico = F.when(ok % 50 == 0, F.lit(560)).otherwise(F.lit(662) + 5 * ((ok * 37 + ck * 11) % 29)).cast("double")
    revenue = F.when(F.col("c_acctbal") < -900, F.lit(0.0)).otherwise(
        F.lit(20000.0) + F.lit(12.0) * F.greatest(F.col("c_acctbal"), F.lit(0.0)))
    loan_amnt = F.floor(F.col("o_totalprice") / F.lit(350.0)).cast("bigint") * 25 + 1000
    dti = F.col("qty") / F.lit(5.0)
    segment = F.col("c_mktsegment")
    staged = base.select(
        ok.alias("id"),
        _calendar_date(orders, "o_orderdate").cast("string").alias("issue_d"),
        revenue.alias("revenue"),
        dti.alias("dti_n"),
        loan_amnt.alias("loan_amnt"),
        fico.alias("fico_n"),
        F.lit(1).cast("bigint").alias("experience_c"),
        _pick(FIXTURE_EMP_LENGTH, ck % 13).alias("emp_length"),
        _pick(FIXTURE_PURPOSE, (ok * 5 + ck) % 14).alias("purpose"),
        F.when(segment == "BUILDING", "OWN").when(segment == "FURNITURE", "OTHER")
        .when(segment == "MACHINERY", "RENT").otherwise("MORTGAGE").alias("home_ownership_n"),
        F.col("n_name").alias("addr_state"),
        F.when(ok % 997 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("Z"), (ck % 900 + 100).cast("string"))).alias("zip_code"),
        F.when(ok % 81 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority")).alias("title"),
        F.when(ok % 11 != 0, F.lit(None).cast("string")).otherwise(F.col("c_name")).alias("desc"),
        ((ok * 7919 + ck * 104729) % 100).alias("noise"),
    )
    threshold = (
        F.lit(8)
        + F.when(F.col("fico_n") < 690, 12).otherwise(0)
        + F.when(F.col("dti_n") > 25, 10).otherwise(0)
        + F.when(F.col("loan_amnt") > F.lit(0.4) * F.col("revenue"), 15).otherwise(0)
    )
    default = F.when(F.col("noise") < threshold, 1).otherwise(0).cast("bigint")
    return staged.select(*[default.alias("Default") if c == "Default" else F.col(c) for c in LOAN_COLUMNS])


def applications(loans_df: DataFrame) -> DataFrame:
    """Scoring input (FIXTURES.md section 3): five applicant fields, bad values planted."""
    i = F.col("id")
    return loans_df.select(
        i.alias("application_id"),
        F.col("revenue"),
        (F.when(i % 7 == 0, F.lit(3.0)).otherwise(F.lit(1.0)) * F.col("loan_amnt")).alias("loan_amnt"),
        F.when(i % 97 == 0, 299).when(i % 89 == 0, 851).otherwise(F.col("fico_n") - 40).cast("int").alias("fico_n"),
        (F.col("dti_n") / F.lit(80.0)).alias("dti_n"),
        F.when(i % 83 == 0, 11).otherwise(i % 11).cast("int").alias("emp_length_numeric"),
    )


def normalize_missing(df: DataFrame, na_tokens: list[str] | None = None) -> DataFrame:
    """Missing-value normalisation at the scan: NA text tokens and NaN become NULL."""
    tokens = NA_TOKENS if na_tokens is None else na_tokens
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.when(c.isin(tokens), F.lit(None).cast("string")).otherwise(c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.nanvl(c, F.lit(None).cast(f.dataType))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def load_csv(spark: SparkSession, path: str, schema: T.StructType = LOAN_SCHEMA,
             sample_size: int | None = None, na_tokens: list[str] | None = None) -> DataFrame:
    """CSV scan with a declared schema (no inference pass), header, NA tokens.

    ``sample_size`` keeps the first n rows, the optional sampling of the
    loader; it is a feature of this source, not a cap used elsewhere.
    """
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("nullValue", "")
        .option("nanValue", "NaN")
        .csv(path)
    )
    if sample_size is not None:
        df = df.limit(int(sample_size))
    return normalize_missing(df, na_tokens)
