"""The distributed running-sum primitive and exact quantiles by rank."""

import random

from pyspark.sql import functions as F

from riskspark.functions import ranks as R
from riskspark.functions.stats import fit_quantiles


def test_rank_quantiles_equal_percentile_with_hot_value(spark, monkeypatch):
    rng = random.Random(1)
    vals = [round(rng.lognormvariate(10, 1), 2) for _ in range(3000)] + [50000.0] * 1500  # a third is one value
    df = spark.createDataFrame([(v, float(i % 17)) for i, v in enumerate(vals)], "x double, y double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0, 1 / 3]
    row = df.agg(*[F.percentile(c, F.array(*[F.lit(p) for p in probs])).alias(c) for c in ("x", "y")]).first()
    want = {c: list(row[c]) for c in ("x", "y")}
    orig = R.cumulative_by_value
    monkeypatch.setattr(R, "cumulative_by_value", lambda *a, **k: orig(*a, **{**k, "rows_per_bucket": 97}))
    got = R.exact_quantiles_by_rank(df, ["x", "y"], probs)
    assert got == want
    # forcing the rank path through the public entry point gives the same numbers
    assert fit_quantiles(df, ["x", "y"], probs) == want


def test_cumulative_by_value_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [(g, float(v), rng.randint(0, 5)) for g in ("a", "b") for v in rng.sample(range(10000), 700)]
    df = spark.createDataFrame(rows, "g string, v double, c long")
    out = R.cumulative_by_value(df, ["g"], "v", ["c"], rows_per_bucket=50).collect()
    by_g = {}
    for g, v, c in rows:
        by_g.setdefault(g, []).append((v, c))
    for r in out:
        below = sum(c for v, c in by_g[r["g"]] if v < r["v"])
        assert r["c_below"] == below
        assert r["c_total"] == sum(c for _, c in by_g[r["g"]])


def test_infinite_values_and_many_buckets(spark):
    inf = float("inf")
    rows = [("g", v, 1) for v in [-inf, -inf, 1.0, 2.0, 3.0, inf, inf, inf]]
    df = spark.createDataFrame(rows, "g string, v double, c long")
    ties = df.groupBy("g", "v").agg(F.sum("c").alias("c"))
    out = {r["v"]: r["c_below"] for r in R.cumulative_by_value(ties, ["g"], "v", ["c"], rows_per_bucket=1).collect()}
    assert out == {-inf: 0, 1.0: 2, 2.0: 3, 3.0: 4, inf: 5}
