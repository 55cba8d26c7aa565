"""Exact quantiles by bracketing: a sketch bounds each one, a scan counts, only the values between are ranked.

1. One aggregate builds a quantile sketch of every column (its size depends on ``SKETCH`` only). A sketch's answer is off by at most
   n / SKETCH ranks, so the answers at p - 2 / SKETCH and p + 2 / SKETCH enclose the order statistics around p.
2. One aggregate counts the rows below each bracket and in it. The same scan takes a sketch of the rows inside, so a bracket that
   still holds more than ``INSIDE`` rows is narrowed again, by the same factor.
3. The values in the brackets, about 4 / SKETCH of the rows, are counted by value and ranked.

No pass shuffles the data: steps 1 and 2 send sketches and counts, step 3 the few values inside. Results are those of the
``percentile`` aggregate, bit by bit. If a count shows that a bracket misses its rank (a sketch beyond its stated error), the
bracket is the whole range for that quantile: slower, the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.columns import col

SKETCH = 1000
INSIDE = 5_000_000
#: Brackets that one plan counts as expressions; more of them are counted by numpy in the tasks, in a plan of fixed size.
MANY = 256
#: Bracket ends that no value lies beyond (NaN is Spark's largest double).
_LOW, _HIGH = float("-inf"), float("nan")


def _between(c, lo: float, hi: float):
    return (c >= F.lit(lo)) & (c <= F.lit(hi))


def _values(df: DataFrame, x: dict, names: list[str]) -> DataFrame:
    return df.select(*[x[c].alias(f"x{i}") for i, c in enumerate(names)])


def _counted(df: DataFrame, x: dict, bracket: dict) -> dict[tuple[str, int], tuple[int, int]]:
    """(rows below, rows inside) of every bracket, by one scan: each value meets its column's sorted bracket ends once.
    Places are counted: 2 i between end i - 1 and end i, 2 i + 1 at end i."""
    names = list(dict.fromkeys(c for c, _ in bracket))
    ends = [np.unique([e for (d, _), pair in bracket.items() if d == c for e in pair]) for c in names]

    def run(batches):
        import pyarrow as pa

        seen = [np.zeros(2 * len(e) + 1, dtype=np.int64) for e in ends]
        for b in batches:
            for i, e in enumerate(ends):
                v = np.asarray(b.column(i).drop_null())
                seen[i] += np.bincount(np.searchsorted(e, v, "left") + np.searchsorted(e, v, "right"), minlength=len(seen[i]))
        rows = [(i, at, n) for i, s in enumerate(seen) for at, n in enumerate(s.tolist()) if n]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["i", "at", "n"])

    found = _values(df, x, names).mapInArrow(run, "i long, at long, n long").groupBy("i", "at").agg(F.sum("n").alias("n")).collect()  # a few numbers for each bracket
    seen = [np.zeros(2 * len(e) + 1, dtype=np.int64) for e in ends]
    for r in found:
        seen[r["i"]][r["at"]] = r["n"]
    out = {}
    for key, (lo, hi) in bracket.items():
        i = names.index(key[0])
        first, last = (2 * int(np.searchsorted(ends[i], v)) + 1 for v in (lo, hi))
        out[key] = int(seen[i][:first].sum()), int(seen[i][first:last + 1].sum())
    return out


def _inside(df: DataFrame, x: dict, bracket: dict, keys: list) -> DataFrame:
    """(k, value, n): the values in the bracket of ``keys[k]``, counted by value."""
    names = list(dict.fromkeys(c for c, _ in keys))
    wanted = [(k, names.index(key[0]), *bracket[key]) for k, key in enumerate(keys)]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            columns = [np.unique(np.asarray(b.column(i).drop_null()) + 0.0, return_counts=True) for i in range(len(names))]  # -0.0 is 0.0
            for k, i, lo, hi in wanted:
                v, n = columns[i]
                part = slice(np.searchsorted(v, lo, "left"), np.searchsorted(v, hi, "right"))
                if part.start < part.stop:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(part.stop - part.start, k, np.int32)), pa.array(v[part]), pa.array(n[part])], ["k", "value", "n"])

    return _values(df, x, names).mapInArrow(run, "k int, value double, n long").groupBy("k", "value").agg(F.sum("n").alias("n"))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], sketch: int = SKETCH, inside: int = INSIDE) -> dict[str, list]:
    """{column: [quantile for each of ``probs``]} by linear interpolation; None for a column without values."""
    cols, probs = list(dict.fromkeys(columns)), [float(p) for p in probs]
    if not cols or not probs:
        return {c: [None] * len(probs) for c in cols}
    x = {c: col(c).cast("double") for c in cols}
    margin = 2.0 / sketch
    asked = F.array(*[F.lit(min(1.0, max(0.0, p + d))) for p in probs for d in (-margin, margin)])
    first = df.agg(*[a.alias(f"{k}{i}") for i, c in enumerate(cols) for k, a in (("n", F.count(x[c])), ("lo", F.min(x[c])), ("hi", F.max(x[c])), ("q", F.percentile_approx(x[c], asked, sketch)))]).first()
    n = {c: first[f"n{i}"] for i, c in enumerate(cols)}
    # one bracket for each (column, probability) that has values; equal ends need no ranking
    bracket: dict[tuple[str, int], tuple[float, float]] = {}
    for i, c in enumerate(cols):
        for j, p in enumerate(probs):
            if n[c]:
                q = first[f"q{i}"]
                bracket[c, j] = (first[f"lo{i}"] if p <= margin else q[2 * j], first[f"hi{i}"] if p >= 1 - margin else q[2 * j + 1])
    below: dict[tuple[str, int], int] = {}
    keys = list(bracket)
    while keys:
        aggs, many = [], len(keys) > MANY
        for k, key in enumerate(keys):
            c, (lo, hi) = x[key[0]], bracket[key]
            if not many:
                aggs += [F.count_if(c < F.lit(lo)).alias(f"b{k}"), F.count_if(_between(c, lo, hi)).alias(f"i{k}")]
            if n[key[0]] * 2 * margin > inside:  # the rank's place inside isn't known yet, so the sketch answers at many places
                aggs.append(F.percentile_approx(F.when(_between(c, lo, hi), c), F.array(*[F.lit(t / sketch) for t in range(sketch + 1)]), sketch).alias(f"q{k}"))
        row = df.agg(*aggs).first().asDict() if aggs else {}
        if many:
            for k, counts in enumerate(_counted(df, x, {key: bracket[key] for key in keys}).values()):
                row[f"b{k}"], row[f"i{k}"] = counts
        again = []
        for k, key in enumerate(keys):
            lo, hi = bracket[key]
            rank = (n[key[0]] - 1) * probs[key[1]]
            under, held = row[f"b{k}"], row[f"i{k}"]
            if not (under <= int(rank) and -(-rank // 1) < under + held):
                bracket[key], below[key] = (_LOW, _HIGH), 0
                continue
            below[key] = under
            if held > inside and lo != hi and f"q{k}" in row:
                ends, at = row[f"q{k}"], (rank - under) / held * sketch
                new = (lo if at < 3 else ends[int(at) - 2], hi if at > sketch - 4 else ends[min(sketch, int(at) + 4)])
                if new != (lo, hi):
                    bracket[key] = new
                    again.append(key)
        keys = again
    out: dict[str, list] = {c: [None] * len(probs) for c in cols}
    open_keys = []
    for key, (lo, hi) in bracket.items():
        if lo == hi:
            out[key[0]][key[1]] = lo
        else:
            open_keys.append(key)
    if not open_keys:
        return out
    if len(open_keys) > MANY:
        counts = _inside(df, x, bracket, open_keys)
    else:
        rows = F.filter(F.array(*[F.when(_between(x[c], *bracket[c, j]), F.struct(F.lit(k).alias("k"), x[c].alias("value"))) for k, (c, j) in enumerate(open_keys)]), lambda e: e.isNotNull())
        counts = df.select(F.inline(rows)).groupBy("k", "value").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("k").orderBy("value")) - F.col("n")
    wanted = {k: (n[c] - 1) * probs[j] for k, (c, j) in enumerate(open_keys)}
    at = lambda f: F.element_at(F.array(*[F.lit(int(f(wanted[k])) - below[key]) for k, key in enumerate(open_keys)]), F.col("k") + 1)
    ranked = counts.withColumn("before", upto)
    holds = lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n"))
    lower, upper = at(lambda h: h // 1), at(lambda h: -(-h // 1))
    picks = ranked.select("k", "value", holds(lower).alias("is_lo"), holds(upper).alias("is_hi")).where("is_lo OR is_hi").collect()  # at most 2 rows a quantile
    ends: dict[int, list] = {}
    for r in picks:
        slot = ends.setdefault(r["k"], [None, None])
        slot[0] = r["value"] if r["is_lo"] else slot[0]
        slot[1] = r["value"] if r["is_hi"] else slot[1]
    for k, (c, j) in enumerate(open_keys):
        h, (lo, hi) = wanted[k], ends[k]
        out[c][j] = lo if lo == hi or h == h // 1 else (-(-h // 1) - h) * lo + (h - h // 1) * hi
    return out
