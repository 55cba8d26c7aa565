"""Reproducible stratified 60/20/20 split and class weights (M1-M4).

Row order is not reproducible across engines, so the split ranks rows by a
hash of (key, seed) inside each class and cuts at exact per-class sizes:

* sizes: test = ceil(0.2 n); the training part of each split is allocated
  to classes by largest remainder (ties -> lower label), the rest of the
  class goes to the held-out part -- so totals and class shares are exact.
* rank without a class-wide window: rows are bucketed by the first
  ``prefix_len`` hex digits of the hash. Bucket counts (a bounded table:
  16^prefix_len x classes rows) give each bucket its offset; a bucket that
  lies wholly inside one split needs nothing more, and only the few
  buckets that straddle a cut are ranked with ``row_number``. A hot class
  (a third of all rows) is thus spread over 65,536 buckets, never one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions import constants as K
from riskspark.functions.columns import col, r6, safe_div
from riskspark.session import reusable, shared_dir


#: More distinct labels than this are not classes (an error, never a cut).
MAX_CLASSES = 1000


def split_hash(key: Column, seed: int = K.RANDOM_STATE, content: list[str] | None = None) -> Column:
    """Hash of (key, seed). A NULL key is replaced by a hash of the columns in ``content``, so rows without
    one are kept and spread like the others."""
    text = key.cast("string")
    if content:
        text = F.coalesce(text, F.concat(F.lit("no key "), F.xxhash64(*[col(c) for c in content]).cast("string")))
    return F.md5(F.concat(text, F.lit(f"|{seed}")))


def _largest_remainder(counts: dict, total_draw: int) -> dict:
    """Allocate ``total_draw`` over classes proportionally; integer remainders, ties to lower label."""
    n = sum(counts.values())
    if n == 0:
        return {k: 0 for k in counts}
    base = {k: (v * total_draw) // n for k, v in counts.items()}
    rem = {k: (v * total_draw) % n for k, v in counts.items()}
    need = total_draw - sum(base.values())
    for k in sorted(counts, key=lambda k: (-rem[k], k))[:need]:
        base[k] += 1
    return base


def split_sizes(counts: dict, test_size: float = K.TEST_SIZE, val_size: float = K.VAL_SIZE) -> dict:
    """Per class: (test, val, train) sizes of the two-step stratified split."""
    n = sum(counts.values())
    n_test = math.ceil(test_size * n)
    keep = _largest_remainder(counts, n - n_test)
    n_temp = n - n_test
    n_val = math.ceil(val_size * n_temp)
    train = _largest_remainder(keep, n_temp - n_val)
    return {k: (counts[k] - keep[k], keep[k] - train[k], train[k]) for k in counts}


def stratified_split(df: DataFrame, key: str = K.KEY, label: str = K.TARGET, seed: int = K.RANDOM_STATE,
                     test_size: float = K.TEST_SIZE, val_size: float = K.VAL_SIZE,
                     prefix_len: int = 4, materialize: bool | None = None) -> DataFrame:
    """M1: ``df`` plus a ``split`` column in {train, val, test}. Every row is in one split, rows with a NULL key too.

    Input passes: one for the bucket counts (checkpointed: a bounded table of
    at most 16^prefix_len rows per class; a longer prefix gives smaller buckets
    and the same split), then the final plan reads the input
    in two branches -- all rows of whole-split buckets (no shuffle) and the
    few of the straddling buckets (ranked). A derived input is written once first.
    """
    src = reusable(df, "split-input", materialize)
    shared_dir(src.sparkSession)
    unnamed = bool(src.where(col(key).isNull()).select(F.lit(1)).take(1))  # only then a hash needs more than the key: other passes read two columns
    h = split_hash(col(key), seed, df.columns if unnamed else None)
    hashed = src.select("*", h.alias("_h"), F.substring(h, 1, prefix_len).alias("_b"))
    buckets = (hashed.groupBy(col(label).alias("_lab"), F.col("_b")).agg(F.count(F.lit(1)).alias("_cnt"))
               .checkpoint(eager=True))
    class_rows = buckets.groupBy("_lab").agg(F.sum("_cnt").alias("n")).limit(MAX_CLASSES + 1).collect()  # one row per class
    unlabelled = sum(int(r["n"]) for r in class_rows if r["_lab"] is None)
    if unlabelled:
        raise ValueError(f"{unlabelled} rows have no {label}: a stratified split needs a label in every row")
    if len(class_rows) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes: not a class label")
    sizes = split_sizes({r["_lab"]: int(r["n"]) for r in class_rows}, test_size, val_size)

    test_cut = F.lit(None).cast("bigint")
    val_cut = F.lit(None).cast("bigint")
    for lab, (t, v, _) in sizes.items():
        test_cut = F.when(F.col("_lab") == F.lit(lab), F.lit(t)).otherwise(test_cut)
        val_cut = F.when(F.col("_lab") == F.lit(lab), F.lit(t + v)).otherwise(val_cut)
    w = Window.partitionBy("_lab").orderBy("_b")
    # bounded table (<= 16^prefix_len rows per class): a window per class over it is cheap
    offsets = buckets.select(
        "_lab", "_b", "_cnt",
        (F.sum("_cnt").over(w) - F.col("_cnt")).alias("_before"),
        test_cut.alias("_tcut"), val_cut.alias("_vcut"))
    lo, hi = F.col("_before"), F.col("_before") + F.col("_cnt")
    offsets = offsets.select(
        "_lab", F.col("_b").alias("_ob"), "_before", "_tcut", "_vcut",
        F.when(hi <= F.col("_tcut"), "test")
        .when((lo >= F.col("_tcut")) & (hi <= F.col("_vcut")), "val")
        .when(lo >= F.col("_vcut"), "train").alias("_whole"))

    # proven bound: 16^prefix_len x MAX_CLASSES rows; left to the optimizer's own size check beyond a few classes
    sent = F.broadcast(offsets) if 16 ** prefix_len * len(class_rows) <= 16 ** 4 * 4 else offsets
    on = (col(label) == F.col("_lab")) & (F.col("_b") == F.col("_ob"))
    whole = hashed.join(sent, on).filter(F.col("_whole").isNotNull()).withColumn("split", F.col("_whole"))
    # at most two buckets a class lie across a cut: only their rows are built for the ranking
    across = {r["_ob"] for r in offsets.where("_whole IS NULL").select("_ob").collect()}
    cut = hashed.where(F.col("_b").isin(across)).join(sent, on).filter(F.col("_whole").isNull())
    rank = F.col("_before") + F.row_number().over(
        Window.partitionBy("_lab", "_b").orderBy("_h", key)) - 1
    cut = cut.withColumn("_rank", rank).withColumn(
        "split", F.when(F.col("_rank") < F.col("_tcut"), "test")
        .when(F.col("_rank") < F.col("_vcut"), "val").otherwise("train"))
    out_cols = [col(c) for c in df.columns] + [F.col("split")]
    return whole.select(*out_cols).unionByName(cut.select(*out_cols))


def stratified_folds(df: DataFrame, folds: int = 3, key: str = K.KEY, label: str = K.TARGET,
                     seed: int = K.RANDOM_STATE, prefix_len: int = 4, materialize: bool | None = None) -> DataFrame:
    """``df`` plus ``fold`` in [0, folds): the rank of a row in its class by hash, modulo ``folds``, so that
    the sizes of one class differ by at most one row between folds.

    The rank is the bucket's offset (bounded table, as in the split) plus the place in the bucket: one
    shuffle on (label, bucket), no window over a class. A NULL label is a class of its own.
    """
    src = reusable(df, "fold-input", materialize)
    shared_dir(src.sparkSession)
    h = split_hash(col(key), seed, df.columns)
    hashed = src.select("*", h.alias("_h"), F.substring(h, 1, prefix_len).alias("_b"))
    buckets = (hashed.groupBy(col(label).alias("_lab"), F.col("_b").alias("_ob")).agg(F.count(F.lit(1)).alias("_cnt"))
               .checkpoint(eager=True))
    w = Window.partitionBy("_lab").orderBy("_ob")
    offsets = buckets.select("_lab", "_ob", (F.sum("_cnt").over(w) - F.col("_cnt")).alias("_before"))
    joined = hashed.join(offsets, col(label).eqNullSafe(F.col("_lab")) & F.col("_b").eqNullSafe(F.col("_ob")))
    place = F.row_number().over(Window.partitionBy("_lab", "_b").orderBy("_h", key))
    return joined.withColumn("fold", F.pmod(F.col("_before") + place - 1, F.lit(folds)).cast("int")).select(
        *[col(c) for c in df.columns], "fold")


def split_summary(split_df: DataFrame, label: str = K.TARGET) -> DataFrame:
    """M2: size, share of all rows and default rate per split."""
    w = Window.partitionBy()
    per = split_df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg(col(label)).alias("rate"))
    return per.select("split", F.col("n").cast("bigint").alias("n"),
                      r6(F.col("n") / F.sum("n").over(w)).alias("share"),
                      r6(F.col("rate")).alias("default_rate"))


def split_record(split_df: DataFrame, label: str = K.TARGET, seed: int = K.RANDOM_STATE) -> DataFrame:
    """S6 for the split: per part its size and default rate, with the seed and the shares that define it."""
    return split_summary(split_df, label).select("split", "n", "default_rate", F.lit(seed).alias("seed"), F.lit(K.TEST_SIZE).alias("test_size"), F.lit(K.VAL_SIZE).alias("val_size"))


def class_weights(train_df: DataFrame, label: str = K.TARGET) -> DataFrame:
    """M3: balanced class weights w_c = n / (2 n_c) (two classes)."""
    per = train_df.groupBy(col(label).alias("label")).agg(F.count(F.lit(1)).alias("n_class"))
    w = Window.partitionBy()
    k = F.count(F.lit(1)).over(w)
    return per.select("label", F.col("n_class").cast("bigint").alias("n_class"),
                      r6(F.sum("n_class").over(w) / (k * F.col("n_class"))).alias("weight"))


def scale_pos_weight(train_df: DataFrame, label: str = K.TARGET) -> DataFrame:
    """M4: n_negative / n_positive of the training split."""
    return train_df.agg(F.count_if(col(label) == 0).cast("bigint").alias("n_negative"),
                        F.count_if(col(label) == 1).cast("bigint").alias("n_positive")).select(
        "n_negative", "n_positive", r6(safe_div(F.col("n_negative"), F.col("n_positive"))).alias("scale_pos_weight"))
