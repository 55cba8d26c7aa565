"""Model evaluation E1-E12 on a scored table ``(model, split, label, p)``.

AUC, KS and the ROC curve all come from one cumulative table built without a
global window (which would pull every row into one task): ties are collapsed
with ``groupBy(groups, p)`` (map-side first, so a score shared by a third of
all rows is one row before the shuffle), then ``ranks.cumulative_by_value``
computes the running positive / negative counts with value buckets whose
edges are approximate quantiles -- balanced however the scores are spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions import constants as K
from riskspark.functions.columns import r6, safe_div
from riskspark.functions.ranks import cumulative_by_value

GROUPS = ("model", "split")
METRICS = ["auc", "gini", "ks", "accuracy", "precision", "recall", "f1"]


def cumulative_table(scored: DataFrame, groups: Sequence[str] = GROUPS, label: str = "label",
                     score: str = "p", rows_per_bucket: int | None = None) -> DataFrame:
    """One row per (group, distinct score): pos, neg, pos_below, neg_below, tot_pos, tot_neg."""
    g = list(groups)
    ties = scored.filter(F.col(score).isNotNull()).groupBy(*g, F.col(score).alias("p")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    kw = {} if rows_per_bucket is None else {"rows_per_bucket": rows_per_bucket}
    cum = cumulative_by_value(ties, g, "p", ["pos", "neg"], **kw)
    return cum.select(*g, "p", "pos", "neg", "pos_below", "neg_below",
                      F.col("pos_total").alias("tot_pos"), F.col("neg_total").alias("tot_neg"))


def ranking_metrics(cum: DataFrame, groups: Sequence[str] = GROUPS) -> DataFrame:
    """Exact AUC (ties count 1/2), Gini = 2 AUC - 1, KS = max(TPR - FPR, 0)."""
    P, N = F.col("tot_pos").cast("double"), F.col("tot_neg").cast("double")
    tpr = safe_div(F.col("tot_pos") - F.col("pos_below"), P)
    fpr = safe_div(F.col("tot_neg") - F.col("neg_below"), N)
    # a group with a single class has no AUC (NULL for that group, not an error for all)
    auc = safe_div(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") * F.lit(0.5))), F.max(P) * F.max(N))
    return cum.groupBy(*groups).agg(auc.alias("auc"), F.greatest(F.max(tpr - fpr), F.lit(0.0)).alias("ks")).select(
        *groups, "auc", (F.lit(2.0) * F.col("auc") - F.lit(1.0)).alias("gini"), "ks")


def roc_curve(cum: DataFrame, groups: Sequence[str] = GROUPS) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score: rates of scores >= threshold."""
    return cum.select(*groups, r6(F.col("p")).alias("threshold"),
                      r6(safe_div(F.col("tot_neg") - F.col("neg_below"), F.col("tot_neg"))).alias("fpr"),
                      r6(safe_div(F.col("tot_pos") - F.col("pos_below"), F.col("tot_pos"))).alias("tpr"))


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def threshold_metrics(scored: DataFrame, groups: Sequence[str] = GROUPS, threshold: float = K.DECISION_THRESHOLD,
                      label: str = "label", score: str = "p") -> DataFrame:
    """Confusion counts at p > threshold and accuracy/precision/recall/F1 (0 on 0/0)."""
    pred = F.col(score) > F.lit(threshold)
    y = F.col(label) == 1
    agg = scored.groupBy(*groups).agg(
        F.count_if(~pred & ~y).cast("bigint").alias("tn"), F.count_if(pred & ~y).cast("bigint").alias("fp"),
        F.count_if(~pred & y).cast("bigint").alias("fn"), F.count_if(pred & y).cast("bigint").alias("tp"))
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    precision = _ratio(tp, tp + fp)
    recall = _ratio(tp, tp + fn)
    return agg.select(*groups, "tn", "fp", "fn", "tp",
                      _ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"), precision.alias("precision"),
                      recall.alias("recall"),
                      _ratio(F.lit(2.0) * precision * recall, precision + recall).alias("f1"))


def gini_band(g: Column) -> Column:
    out = None
    for cut, text in K.GINI_BANDS:
        out = F.when(g > F.lit(cut), F.lit(text)) if out is None else out.when(g > F.lit(cut), F.lit(text))
    return out.otherwise(F.lit(K.GINI_ELSE))


def ks_band(k: Column) -> Column:
    out = None
    for cut, text in K.KS_BANDS:
        out = F.when(k > F.lit(cut), F.lit(text)) if out is None else out.when(k > F.lit(cut), F.lit(text))
    return out.otherwise(F.lit(K.KS_ELSE))


def threshold_metrics_from_cum(cum: DataFrame, groups: Sequence[str] = GROUPS,
                               threshold: float = K.DECISION_THRESHOLD) -> DataFrame:
    """E5-E6 from the per-score table: predicted positive = scores above the threshold."""
    above = F.col("p") > F.lit(threshold)
    agg = cum.groupBy(*groups).agg(
        F.sum(F.when(~above, F.col("neg")).otherwise(0)).cast("bigint").alias("tn"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).cast("bigint").alias("fp"),
        F.sum(F.when(~above, F.col("pos")).otherwise(0)).cast("bigint").alias("fn"),
        F.sum(F.when(above, F.col("pos")).otherwise(0)).cast("bigint").alias("tp"))
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    precision = _ratio(tp, tp + fp)
    recall = _ratio(tp, tp + fn)
    return agg.select(*groups, "tn", "fp", "fn", "tp",
                      _ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"), precision.alias("precision"),
                      recall.alias("recall"),
                      _ratio(F.lit(2.0) * precision * recall, precision + recall).alias("f1"))


def metrics(scored: DataFrame, groups: Sequence[str] = GROUPS) -> DataFrame:
    """All metrics per (model, split), unrounded -- one read of the scored table: ranking and
    threshold metrics both come from the checkpointed per-score table."""
    cum = cumulative_table(scored, groups)
    return ranking_metrics(cum, groups).join(threshold_metrics_from_cum(cum, groups), list(groups))


def model_comparison(scored: DataFrame, model_order: Sequence[str] | None = None, rounded: bool = True) -> DataFrame:
    """One row per model, val_* and test_* metrics, test confusion counts, bands (from unrounded
    metrics). ``rounded=False`` keeps the metrics as they are: what decides between models takes those."""
    show = r6 if rounded else (lambda c: c)
    m = metrics(scored, GROUPS)
    aggs = []
    for s in ("val", "test"):
        for name in METRICS:
            aggs.append(F.max(F.when(F.col("split") == s, F.col(name))).alias(f"{s}_{name}"))
    for c in ("tn", "fp", "fn", "tp"):
        aggs.append(F.max(F.when(F.col("split") == "test", F.col(c))).alias(f"test_{c}"))
    wide = m.groupBy(F.col("model").alias("model_name")).agg(*aggs)
    cols = [F.col("model_name")]
    cols += [show(F.col(f"{s}_{n}")).alias(f"{s}_{n}") for s in ("val", "test") for n in METRICS]
    cols += [F.col(f"test_{c}") for c in ("tn", "fp", "fn", "tp")]
    cols += [gini_band(F.col("test_gini")).alias("gini_interpretation"),
             ks_band(F.col("test_ks")).alias("ks_interpretation")]
    out = wide.select(*cols)
    if model_order:
        order = F.array_position(F.array(*[F.lit(x) for x in model_order]), F.col("model_name"))
        out = out.withColumn("model_rank", order.cast("int"))
    return out


def _first_by_auc(order_col: str):
    auc = F.nanvl(F.col("test_auc"), F.lit(None).cast("double"))
    known = F.when(auc.isNotNull(), F.col("model_name"))
    return F.min_by(known, F.struct(auc.isNull(), -auc, F.col(order_col)))


def best_model(comparison: DataFrame, order_col: str = "model_rank") -> DataFrame:
    """The best model (a later model wins only with a strictly greater test AUC)
    and the best AUC / Gini / KS taken independently. Takes unrounded metrics, rounds last.
    A model without an AUC (NULL or NaN) never wins; NULL if no model has one."""
    return comparison.agg(
        _first_by_auc(order_col).alias("best_model"),
        r6(F.max("test_auc")).alias("best_auc"), r6(F.max("test_gini")).alias("best_gini"),
        r6(F.max("test_ks")).alias("best_ks"))


def leaderboard(comparison: DataFrame, order_col: str = "model_rank") -> DataFrame:
    """Every model row plus the flag of the row with the highest test AUC (ties -> earlier model).

    The comparison table has one row per model, so a window over it is free.
    """
    w = Window.partitionBy()
    best = _first_by_auc(order_col).over(w)
    return comparison.select(
        "model_name", *[r6(F.col(c)).alias(c) for c in ("test_auc", "test_gini", "test_ks", "test_f1")],
        F.coalesce((F.col("model_name") == best).cast("int"), F.lit(0)).alias("is_best"))
