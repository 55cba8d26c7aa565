"""Ranking and threshold metrics: exact AUC with ties, KS, confusion counts, best-model rule."""

import random

from pyspark.sql import functions as F

from riskspark.operators import evaluate as EV


def _scored(spark, pairs, model="m", split="test"):
    return spark.createDataFrame([(model, split, y, p) for y, p in pairs], "model string, split string, label long, p double")


def _rank(spark, pairs, rows_per_bucket=None):
    return EV.ranking_metrics(EV.cumulative_table(_scored(spark, pairs), rows_per_bucket=rows_per_bucket)).first()


def _brute_auc(pairs):
    pos = [p for y, p in pairs if y == 1]
    neg = [p for y, p in pairs if y == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def _brute_ks(pairs):
    P = sum(1 for y, _ in pairs if y == 1)
    N = len(pairs) - P
    best = 0.0
    for t in sorted({p for _, p in pairs}):
        tpr = sum(1 for y, p in pairs if y == 1 and p >= t) / P
        fpr = sum(1 for y, p in pairs if y == 0 and p >= t) / N
        best = max(best, tpr - fpr)
    return best


def test_auc_edge_cases(spark):
    assert _rank(spark, [(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.5)])["auc"] == 0.5
    assert _rank(spark, [(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)])["auc"] == 1.0
    rev = _rank(spark, [(1, 0.1), (1, 0.2), (0, 0.8), (0, 0.9)])
    assert rev["auc"] == 0.0 and rev["ks"] == 0.0  # KS is never negative


def test_auc_ks_match_brute_force_with_ties_and_few_buckets(spark):
    rng = random.Random(7)
    pairs = [(rng.random() < 0.3, round(rng.random(), 2)) for _ in range(400)]
    pairs = [(int(y), p) for y, p in pairs]
    for rows_per_bucket in (None, 7, 1):  # one bucket, ~15 buckets, one value per bucket
        r = _rank(spark, pairs, rows_per_bucket=rows_per_bucket)
        assert abs(r["auc"] - _brute_auc(pairs)) < 1e-12
        assert abs(r["ks"] - _brute_ks(pairs)) < 1e-12
        assert abs(r["gini"] - (2 * r["auc"] - 1)) < 1e-12


def test_auc_of_negated_score(spark):
    rng = random.Random(3)
    pairs = [(int(rng.random() < 0.4), round(rng.random(), 1)) for _ in range(300)]
    a = _rank(spark, pairs)["auc"]
    b = _rank(spark, [(y, -p) for y, p in pairs], rows_per_bucket=5)["auc"]
    assert abs(a + b - 1.0) < 1e-12


def test_auc_matches_mllib_exact(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rng = random.Random(11)
    pairs = [(int(rng.random() < 0.25), round(rng.random(), 3)) for _ in range(2000)]
    df = spark.createDataFrame([(float(y), p) for y, p in pairs], "label double, p double")
    ev = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="label", numBins=0)
    assert abs(ev.evaluate(df) - _rank(spark, pairs)["auc"]) < 1e-12


def test_threshold_metrics_zero_denominators(spark):
    df = _scored(spark, [(0, 0.1), (0, 0.2), (1, 0.3)])
    r = EV.threshold_metrics(df).first()
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (2, 0, 1, 0)
    assert r["precision"] == 0.0 and r["recall"] == 0.0 and r["f1"] == 0.0
    assert abs(r["accuracy"] - 2 / 3) < 1e-12


def test_threshold_is_strict(spark):
    r = EV.threshold_metrics(_scored(spark, [(1, 0.5), (1, 0.51)])).first()
    assert (r["fn"], r["tp"]) == (1, 1)


def test_best_model_tie_goes_to_first(spark):
    comp = spark.createDataFrame([("Logistic Regression", 0.7, 0.4, 0.3, 0.5, 1), ("Gradient Boosted Trees", 0.7, 0.4, 0.3, 0.5, 2)],
                                 "model_name string, test_auc double, test_gini double, test_ks double, test_f1 double, model_rank int")
    assert EV.best_model(comp).first()["best_model"] == "Logistic Regression"
    board = {r["model_name"]: r["is_best"] for r in EV.leaderboard(comp).collect()}
    assert board == {"Logistic Regression": 1, "Gradient Boosted Trees": 0}


def test_bands(spark):
    df = spark.createDataFrame([(0.51,), (0.5,), (0.31,), (0.2,)], "g double")
    got = [r[0] for r in df.select(EV.gini_band(F.col("g"))).collect()]
    assert got == ["Excellent - Strong discrimination", "Good - Acceptable discrimination",
                   "Fair - Minimum acceptable", "Poor - Needs improvement"]


def test_single_class_group_gives_null_not_error(spark):
    df = spark.createDataFrame([("m", "a", 1, 0.3), ("m", "a", 1, 0.4), ("m", "b", 0, 0.2), ("m", "b", 1, 0.6)],
                               "model string, split string, label long, p double")
    r = {x["split"]: x for x in EV.metrics(df).collect()}
    assert r["a"]["auc"] is None and r["b"]["auc"] == 1.0


def test_empty_table_profile(spark):
    from riskspark.operators import profile as P

    df = spark.createDataFrame([], "id long, Default long")
    q = P.quality_profile(df).first()
    assert q["rows"] == 0 and q["missing_pct"] is None
