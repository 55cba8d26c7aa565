"""Running sums over a sorted value without a global window.

A window ordered over a whole table runs in one task. ``cumulative_by_value``
computes, for every row of a table that has one row per (group, value), the
sums of count columns over all rows of the same group with a smaller value:

1. the table is checkpointed to the shared folder (it is read several times;
   the checkpoint also cuts lineage, so a lost executor re-reads files);
2. the bucket count grows with the number of rows (``rows_per_bucket``),
   and the bucket edges are approximate quantiles of the value, so buckets
   hold about the same number of rows however skewed the values are -- a
   value that repeats a third of all input rows is a single row here,
   because callers collapse ties before calling;
3. ``Bucketizer`` (a JVM binary search) assigns buckets; any monotone
   bucketing is exact, the quantile edges only balance the work;
4. bucket totals (at most ``max_buckets`` rows per group: a bounded table,
   broadcast only when its size is under ``broadcast_rows``) get their running
   offsets from a window per group; a window per (group, bucket) finishes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 2_000_000
MAX_BUCKETS = 65_536
BROADCAST_ROWS = 2_000_000


def cumulative_by_value(df: DataFrame, groups: Sequence[str], value: str, sums: Sequence[str],
                        rows_per_bucket: int = ROWS_PER_BUCKET, max_buckets: int = MAX_BUCKETS,
                        broadcast_rows: int = BROADCAST_ROWS, checkpoint: bool = True) -> DataFrame:
    """``df`` plus ``<s>_below`` (sum over smaller values in the group) and ``<s>_total`` per group."""
    from riskspark.session import shared_dir

    g = list(groups)
    if checkpoint:
        shared_dir(df.sparkSession)  # checkpoint() writes to spark.checkpoint.dir
    t = df.checkpoint(eager=True) if checkpoint else df
    n_rows = t.count()
    n_buckets = int(min(max_buckets, max(1, math.ceil(n_rows / rows_per_bucket))))
    if n_buckets == 1:
        t = t.withColumn("_bk", F.lit(0.0))
    else:
        probs = [i / n_buckets for i in range(1, n_buckets)]
        edges = sorted(set(x for x in t.approxQuantile(value, probs, 1.0 / (4 * n_buckets))
                           if x == x and abs(x) != float("inf")))  # splits must stay strictly increasing
        splits = [-float("inf")] + edges + [float("inf")]
        t = Bucketizer(splits=splits, inputCol=value, outputCol="_bk", handleInvalid="keep").transform(
            t.withColumn(value, F.col(value).cast("double")) if dict(t.dtypes)[value] != "double" else t)
    totals = t.groupBy(*g, "_bk").agg(*[F.sum(s).alias(f"_bt_{s}") for s in sums])
    before = Window.partitionBy(*g).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*g)
    offsets = totals.select(
        *g, "_bk",
        *[F.coalesce(F.sum(f"_bt_{s}").over(before), F.lit(0)).alias(f"_off_{s}") for s in sums],
        *[F.sum(f"_bt_{s}").over(whole).alias(f"{s}_total") for s in sums])
    # the offsets table has at most n_buckets rows per group
    n_groups = t.select(*g).distinct().count() if g else 1
    if n_buckets * n_groups <= broadcast_rows:
        offsets = F.broadcast(offsets)
    joined = t.join(offsets, [*g, "_bk"])
    within = Window.partitionBy(*g, "_bk").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return joined.select(
        *[c for c in df.columns],
        *[(F.col(f"_off_{s}") + F.coalesce(F.sum(s).over(within), F.lit(0))).alias(f"{s}_below") for s in sums],
        *[F.col(f"{s}_total") for s in sums])


def exact_quantiles_by_rank(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict:
    """Exact linear-interpolation quantiles of many columns without a single-task value map.

    Long form (column, value) -> count per distinct value (one shuffle, map-side
    combined) -> running counts (above) -> the two order statistics around each
    position -> interpolation, with the same formula as the ``percentile``
    aggregate. Returns {column: [q for q in probs]}.
    """
    cols = list(columns)
    if not cols:
        return {}
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"),
                                                   F.col(f"`{c}`").cast("double").alias("value"))
                                         for c in cols]))).filter(F.col("value").isNotNull())
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    cum = cumulative_by_value(counts, ["column_name"], "value", ["n"])
    # wanted 0-based ranks per column: floor(h), ceil(h) with h = (N - 1) p
    cum = cum.select("column_name", "value", "n", "n_below", "n_total")
    pos = []
    for i, p in enumerate(probs):
        h = (F.col("n_total") - 1) * F.lit(float(p))
        pos.append(F.struct(F.lit(i).alias("k"), F.floor(h).alias("lo"), F.ceil(h).alias("hi"), h.alias("h")))
    picks = cum.select("column_name", "value", "n", "n_below", F.explode(F.array(*pos)).alias("w")).filter(
        ((F.col("w.lo") >= F.col("n_below")) & (F.col("w.lo") < F.col("n_below") + F.col("n")))
        | ((F.col("w.hi") >= F.col("n_below")) & (F.col("w.hi") < F.col("n_below") + F.col("n"))))
    rows = picks.select(
        "column_name", F.col("w.k").alias("k"), F.col("w.h").alias("h"), F.col("w.lo").alias("lo"),
        F.col("w.hi").alias("hi"), "value",
        ((F.col("w.lo") >= F.col("n_below")) & (F.col("w.lo") < F.col("n_below") + F.col("n"))).alias("is_lo"),
        ((F.col("w.hi") >= F.col("n_below")) & (F.col("w.hi") < F.col("n_below") + F.col("n"))).alias("is_hi"),
    ).collect()  # at most 2 rows per (column, probability)
    found: dict = {}
    for r in rows:
        slot = found.setdefault((r["column_name"], r["k"]), {"h": r["h"], "lo": r["lo"], "hi": r["hi"]})
        if r["is_lo"]:
            slot["vlo"] = r["value"]
        if r["is_hi"]:
            slot["vhi"] = r["value"]
    out = {}
    for c in cols:
        vals = []
        for k in range(len(probs)):
            s = found.get((c, k))
            if s is None:
                vals.append(None)
            elif s["lo"] == s["hi"] or s["vlo"] == s["vhi"]:
                vals.append(s["vlo"])
            else:
                vals.append((s["hi"] - s["h"]) * s["vlo"] + (s["h"] - s["lo"]) * s["vhi"])
        out[c] = vals
    return out
