"""Bracketed quantiles are those of the percentile aggregate, bit by bit."""

import random

import pytest
from pyspark.sql import functions as F

from riskspark.functions import quantiles as Q
from riskspark.functions import ranks

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def want(df, columns, probs=PROBS):
    row = df.agg(*[F.percentile(F.col(c).cast("double"), F.array(*[F.lit(p) for p in probs])).alias(c) for c in columns]).first()
    return {c: list(row[c]) if row[c] is not None else [None] * len(probs) for c in columns}


def data(spark, n, seed=3):
    rng = random.Random(seed)
    rows = [(rng.gauss(0, 1) * 10 ** rng.randint(-3, 6), rng.choice([0.0, 0.0, 0.0, 1.0]), rng.choice([None, 5.0, -7.25]), float(rng.randint(0, 30)), None, 4.5, i) for i in range(n)]
    return spark.createDataFrame(rows, "wide double, flag double, gaps double, ties double, none double, same double, whole long")


COLS = ["wide", "flag", "gaps", "ties", "none", "same", "whole"]


@pytest.mark.parametrize("n,sketch", [(1, 1000), (2, 100), (3, 1000), (2500, 100), (2500, 20), (997, 1000)])
def test_equal_to_percentile(spark, n, sketch):
    df = data(spark, n).repartition(7)
    assert Q.exact_quantiles(df, COLS, PROBS, sketch=sketch) == want(df, COLS)


def test_brackets_are_narrowed_until_few_rows_are_inside(spark):
    df = data(spark, 4000).repartition(5)
    assert Q.exact_quantiles(df, COLS, PROBS, sketch=50, inside=20) == want(df, COLS)


def test_a_sketch_beyond_its_error_costs_time_only(spark, monkeypatch):
    df = data(spark, 600)
    real = F.percentile_approx
    monkeypatch.setattr(Q.F, "percentile_approx", lambda c, p, a: real(c + F.lit(1e9), p, a))
    assert Q.exact_quantiles(df, ["wide", "ties"], [0.25, 0.75]) == want(df, ["wide", "ties"], [0.25, 0.75])


def test_agrees_with_the_rank_plan_on_infinities(spark):
    df = spark.createDataFrame([(float("-inf"),), (float("inf"),), (0.0,), (-0.5,), (3.0,), (None,)], "x double")
    assert Q.exact_quantiles(df, ["x"], [0.25, 0.5, 0.75]) == ranks.exact_quantiles_by_rank(df, ["x"], [0.25, 0.5, 0.75])


def test_no_values_no_columns(spark):
    df = spark.createDataFrame([], "x double")
    assert Q.exact_quantiles(df, ["x"], [0.5]) == {"x": [None]} and Q.exact_quantiles(df, [], [0.5]) == {}


def test_data_is_not_shuffled(spark):
    """Of 200,000 rows only the values in the brackets reach an exchange."""
    df = spark.range(200_000).select(F.rand(5).alias("x"))
    seen = []
    real = Q.F.inline
    Q.F.inline = lambda c: (seen.append(c), real(c))[1]
    try:
        got = Q.exact_quantiles(df, ["x"], [0.25, 0.75])
    finally:
        Q.F.inline = real
    assert got == want(df, ["x"], [0.25, 0.75])
    assert df.select(real(seen[0])).count() < 0.02 * 200_000


def test_many_brackets_are_counted_in_a_plan_of_fixed_size(spark, monkeypatch):
    from riskspark.functions import quantiles as Q

    rows = [(i, None if i % 11 == 0 else float((i * 37) % 201), -0.0 if i % 3 else 0.0, float("nan") if i % 5 == 0 else i / 7, None) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double").repartition(5)
    probs, names = [i / 40 for i in range(1, 40)], ["a", "b", "c", "d"]
    want = df.agg(*[F.percentile(c, F.array(*[F.lit(p) for p in probs])).alias(c) for c in names]).first()
    monkeypatch.setattr(Q, "MANY", 0)
    for sketch in (1000, 20):  # a rough sketch leaves wide brackets
        got = Q.exact_quantiles(df, names, probs, sketch=sketch)
        for c in names:
            assert repr([v if v is None else v + 0.0 for v in got[c]]) == repr([v + 0.0 for v in want[c]] if want[c] else [None] * len(probs))  # of -0.0 and 0.0 either may be met
