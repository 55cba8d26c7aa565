"""Quarantine, partitioned sink, incremental profile, split and leaderboard edge cases, entry without the separable part."""

import pathlib
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from riskspark.operators import evaluate as EV
from riskspark.operators import incremental as I
from riskspark.operators import profile as P
from riskspark.operators import split as S
from riskspark.session import scratch_path
from riskspark.sources import loans as L
from riskspark.sources import quarantine as Q
from riskspark.sources import sinks

HEAD = ",".join(L.LOAN_COLUMNS)


def write(spark, lines):
    path = scratch_path(spark, "csv-bad")
    spark.sparkContext.parallelize([HEAD, *lines], 1).saveAsTextFile(path)
    return path


def test_broken_rows_go_to_the_rejects(spark):
    path = write(spark, ["1,2015-12-01,50000,10.5,1000,700,1,n/a,car,RENT,CA,Z100,0,NA,",
                         "2,2015-12-01,NaN,null,2000,710,1,3 years,house,OWN,NY,,1,x,y",
                         "3,not a day,60000,12,3000,720,1,10+ years,medical,OWN,NY,Z101,0,t,d",
                         "4,2015-12-01,much,12,3x,720,1,,medical,OWN,NY,Z101,0,t,d",
                         "5,2015-12-01,60000", '6,Dec-2015,60000,12,3000,720,1,,car,OWN,NY,Z,0,"a, b",d'])
    scan = Q.scan_csv(spark, path)
    good = {r["id"]: r for r in scan.rows.collect()}
    assert set(good) == {1, 2, 3, 6} and scan.rows.schema.names == L.LOAN_COLUMNS
    assert [f.dataType for f in scan.rows.schema.fields] == [f.dataType for f in L.LOAN_SCHEMA.fields]
    assert good[2]["revenue"] is None and good[2]["dti_n"] is None and good[6]["title"] == "a, b" and good[1]["title"] is None
    rejects = {r["line"].split(",")[0]: r["reasons"] for r in scan.rejects.collect()}
    assert rejects == {"4": ["not a number: revenue", "not a number: loan_amnt"], "5": ["wrong number of fields"]}
    assert scan.counts().first().asDict() == {"rows": 6, "good_rows": 4, "rejected_rows": 2, "wrong_fields": 1, "unparsed_numbers": 2, "unparsed_dates": 1}
    assert scan.rows.orderBy("id").collect() == [r for r in L.load_csv(spark, path).orderBy("id").collect() if r["id"] in good]


def test_header_is_checked(spark):
    path = scratch_path(spark, "csv-head")
    spark.sparkContext.parallelize([HEAD.replace("fico_n", "score"), "1"], 1).saveAsTextFile(path)
    with pytest.raises(ValueError, match="missing columns: fico_n; unknown columns: score"):
        Q.scan_csv(spark, path)
    other = scratch_path(spark, "csv-order")
    spark.sparkContext.parallelize([",".join(reversed(L.LOAN_COLUMNS))], 1).saveAsTextFile(other)
    with pytest.raises(ValueError, match="another order"):
        Q.scan_csv(spark, other)
    assert Q.scan_csv(spark, write(spark, [])).counts().first()["rows"] == 0


def test_rewriting_one_partition_leaves_the_others(spark):
    path = scratch_path(spark, "by-year")
    df = spark.range(100).select("id", (2010 + F.col("id") % 4).cast("int").alias("year"))
    sinks.write_partitions(df, path, "year")
    sinks.write_partitions(df.where("year = 2011").withColumn("id", F.col("id") + 1000), path, "year")
    back = spark.read.parquet(path)
    assert back.count() == 100 and back.where("year = 2011").agg(F.min("id")).first()[0] == 1001 and back.where("id < 1000").count() == 75
    plan = back.where("year = 2012")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_incremental_profile_reads_new_files_only(spark):
    path, store = scratch_path(spark, "grow"), scratch_path(spark, "parts")
    cols = ["id", "x", "Default"]
    make = lambda a, b: spark.range(a, b).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("x"), (F.col("id") % 2).alias("Default"))
    make(0, 300).repartition(2).write.parquet(f"{path}/a")
    assert I.update(spark, path, store, cols) == I.Update(0, 2, 0)
    make(300, 400).repartition(1).write.parquet(f"{path}/b")
    assert I.update(spark, path, store, cols) == I.Update(2, 1, 0)
    assert I.update(spark, path, store, cols) == I.Update(3, 0, 0)
    fresh = scratch_path(spark, "parts")
    I.update(spark, path, fresh, cols)
    merged, whole = (I.merged_profile(spark, path, s, cols).orderBy("column_name").collect() for s in (store, fresh))
    assert merged == whole
    by = {r["column_name"]: r for r in merged}
    assert by["id"]["rows"] == 400 and by["x"]["non_null"] == 266 and by["id"]["positives"] == 200 and abs(by["id"]["distinct_estimate"] - 400) < 20
    assert by["x"]["distinct_estimate"] == 5


def test_duplicates_with_nulls_collisions_and_many_columns(spark):
    wide = spark.createDataFrame([(1, None), (None, 1), (1, None), (None, None), (None, None), (2, 2)], "a long, b long")
    wide = wide.select("a", "b", *[F.lit(i if i % 2 else None).cast("long").alias(f"c{i}") for i in range(70)])
    assert tuple(P.duplicate_count(wide).first()) == (2, 4)
    assert tuple(P.duplicate_count(wide.limit(0)).first()) == (0, 0)
    hot = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("v"))
    assert tuple(P.duplicate_count(hot).first()) == (1000 - hot.distinct().count(), hot.distinct().count())


def test_rows_without_an_id_stay_in_the_split(spark):
    df = spark.range(200).select(F.when(F.col("id") % 10 > 0, F.col("id")).alias("id"), (F.col("id") % 4 == 0).cast("long").alias("Default"), (F.col("id") % 7).alias("x"))
    for prefix in (1, 4):
        out = S.stratified_split(df, prefix_len=prefix)
        sizes = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
        assert sizes == {"test": 40, "val": 40, "train": 120} and out.where("id IS NULL").count() == 20


def test_a_model_without_an_auc_never_wins(spark):
    cols = "model_name string, model_rank int, test_auc double, test_gini double, test_ks double, test_f1 double"
    rows = [("a", 0, None, None, None, 0.1), ("b", 1, 0.7, 0.4, 0.3, 0.1), ("c", 2, float("nan"), 0.4, 0.3, 0.1)]
    assert EV.best_model(spark.createDataFrame(rows, cols)).first()["best_model"] == "b"
    assert {r["model_name"]: r["is_best"] for r in EV.leaderboard(spark.createDataFrame(rows, cols)).collect()} == {"a": 0, "b": 1, "c": 0}
    none = spark.createDataFrame(rows[:1], cols)
    assert EV.best_model(none).first()["best_model"] is None and EV.leaderboard(none).first()["is_best"] == 0


def test_the_rest_stands_without_the_separable_folders(tmp_path):
    root = pathlib.Path(__file__).resolve().parent.parent
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    code = ("import __spark_entry__ as E; q, s = E.queries(), E.oracle_sql(); assert set(s) <= set(q) and len(q) > 70; "
            "assert not any(k.startswith('op') or k == 'pipeline' for k in q)")
    for keep in (True, False):
        if not keep:
            (copy / "corpus_pipeline.py").unlink()
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr
