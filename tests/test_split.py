"""Stratified split: exact sizes, disjoint and complete, boundary buckets equal a global rank."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskspark.operators import split as S


def _frame(spark, n=5000, rate=0.2):
    return spark.createDataFrame([(i, int((i * 7919) % 100 < rate * 100)) for i in range(1, n + 1)],
                                 "id long, Default long")


def test_sizes_match_reference_totals():
    sizes = S.split_sizes({0: 1078432, 1: 269249})
    n = 1078432 + 269249
    test = sum(v[0] for v in sizes.values())
    val = sum(v[1] for v in sizes.values())
    train = sum(v[2] for v in sizes.values())
    assert (train, val, test) == (808608, 269536, 269537)
    assert test == math.ceil(0.2 * n)


def test_split_disjoint_complete_stratified(spark):
    df = _frame(spark)
    out = S.stratified_split(df).cache()
    assert out.count() == 5000 and out.select("id").distinct().count() == 5000
    per = {(r["split"], r["Default"]): r["count"] for r in out.groupBy("split", "Default").count().collect()}
    counts = {lab: sum(v for (s, l), v in per.items() if l == lab) for lab in (0, 1)}
    sizes = S.split_sizes(counts)
    for lab, (t, v, tr) in sizes.items():
        assert per[("test", lab)] == t and per[("val", lab)] == v and per[("train", lab)] == tr


def test_bucketed_rank_equals_global_rank(spark):
    df = _frame(spark, n=3000)
    fast = {r["id"]: r["split"] for r in S.stratified_split(df, prefix_len=1).collect()}
    # brute force: one window over each whole class
    h = S.split_hash(F.col("id"))
    counts = {r["Default"]: r["count"] for r in df.groupBy("Default").count().collect()}
    sizes = S.split_sizes(counts)
    ranked = df.withColumn("rk", F.row_number().over(Window.partitionBy("Default").orderBy(h, "id")) - 1).collect()
    for r in ranked:
        t, v, _ = sizes[r["Default"]]
        want = "test" if r["rk"] < t else "val" if r["rk"] < t + v else "train"
        assert fast[r["id"]] == want


def test_class_weights_balanced(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "Default long")
    w = {r["label"]: r["weight"] for r in S.class_weights(df).collect()}
    assert abs(w[0] - 8 / 12) < 1e-6 and w[1] == 2.0  # reported rounded to 6 places
    assert S.scale_pos_weight(df).first()["scale_pos_weight"] == 3.0


def test_split_reads_two_columns_unless_a_key_is_missing(spark):
    """The hash of a row needs its other columns only where a key is NULL; the rows for the ranking are filtered by bucket first."""
    df = spark.range(2000).select("id", (F.col("id") % 4 == 0).cast("long").alias("Default"), (F.col("id") * 2.0).alias("x"))
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    named = S.stratified_split(df, prefix_len=1, materialize=False)
    assert "no key " not in plan(named) and " IN" in plan(named)
    some = df.withColumn("id", F.when(F.col("id") % 100 != 7, F.col("id")))
    unnamed = S.stratified_split(some, prefix_len=1, materialize=False)
    assert "no key " in plan(unnamed) and unnamed.count() == 2000
    assert {r["split"]: r["count"] for r in named.groupBy("split").count().collect()} == {"train": 1200, "val": 400, "test": 400}
    assert {r["split"]: r["count"] for r in unnamed.groupBy("split").count().collect()} == {"train": 1200, "val": 400, "test": 400}


def test_spread_writes_with_methods_that_are_compiled(spark, monkeypatch):
    from riskspark import session

    seen, written = [], session.materialize
    limit = "spark.sql.codegen.hugeMethodLimit"
    monkeypatch.setattr(session, "materialize", lambda df, name: seen.append(spark.conf.get(limit)) or written(df, name))
    before = spark.conf.get(limit)
    assert session.spread(spark.range(50), "spread-test").count() == 50
    assert seen[0] == "8000" and spark.conf.get(limit) == before
