"""Approximate nearest neighbours by largest inner product: a hierarchical navigable small-world graph
per shard, stored as flat neighbour arrays, searched shard by shard and merged.

Equal vectors are one point with its smallest ids. A shard holds a bounded number of points whose norms
lie in one narrow band, brought near 1 by a power of two. Inner product is turned into
distance by one more coordinate that brings all points of a shard to the same length. Each layer holds the points whose hashed level reaches it; inside the shard's bound the
candidates of a layer are exact, and a point keeps those that are nearer to it than to one kept
before, in both directions. A search scans the top layer, then walks each layer down with a beam,
for a block of queries at a time. All that the last beam holds is scored in double precision. Every
shard is walked once; what all shards hold together tells which of them are worth a wider beam.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.common import stage, to_batch, with_python

K = 20
SHARD_POINTS = 8192
QUERY_BLOCK = 512
LINKS = 16
BEAM = 80
TOP_LAYER = 48
#: Largest widening of the beam, in all, for a query that does not settle. The first walk of a shard takes twice the beam.
WIDEN = 8
#: Norm bands of a factor of two.
BANDS = 4
#: Open points that a beam walk expands in one step.
AT_ONCE = 4
#: Pairs of a query and a point that are scored at a time: their vectors stay in the cache.
SCORED = 2048


def valid_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>): without vectors that are NULL, empty, zero, or hold NULL or non-finite parts."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & ok & F.col("vec_id").isNotNull())


def points_of(vectors: DataFrame, k: int = K) -> DataFrame:
    """(rep, dim, v, ids): distinct vectors with their k + 1 smallest ids. Larger ids of equal vectors
    cannot be among any k nearest, as ties go to smaller ids."""
    ranked = vectors.distinct().withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    return ranked.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rep"), F.size("v").alias("dim"), "v", "ids")


def norm_band(v):
    """Rounded binary logarithm of the norm in steps of 1 / BANDS, without overflow: norms of a band differ by a factor
    of 2 ** (1 / BANDS) at most, so the lifted coordinate does not outweigh the directions."""
    top = F.array_max(F.transform(v, F.abs))
    plain = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    scaled = F.log2(top) + F.log2(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x / top) * (x / top))) / 2
    return F.floor(F.when(plain.between(1e-200, 1e300), F.log2(plain) / 2).otherwise(scaled) * BANDS + 0.5).cast("int")


def _unit(x: np.ndarray) -> np.ndarray:
    """``x`` times a power of two that brings its largest part near 1: changes no order of inner products."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, initial=0.0, keepdims=True))[1])


def _lift(x: np.ndarray) -> np.ndarray:
    """One more coordinate so that all rows are equally long: distance order is inner-product order."""
    x = _unit(x.reshape(1, -1)).reshape(x.shape)  # one factor for all rows
    size = np.einsum("ij,ij->i", x, x)
    return np.hstack([x, np.sqrt(np.maximum(size.max() - size, 0.0))[:, None]]).astype(np.float32)


def _layer(x: np.ndarray, links: int) -> np.ndarray:
    """(n, 2 * links) neighbours of every row, -1 where there are fewer."""
    n = len(x)
    width = 2 * links
    if n <= width:
        out = np.full((n, width), -1, np.int32)
        for i in range(n):
            out[i, :n - 1] = np.delete(np.arange(n), i)
        return out
    wide = min(n - 1, 3 * links)
    near = np.empty((n, wide), np.int32)
    sim = np.empty((n, wide), np.float32)
    for s in range(0, n, 512):
        d = x[s:s + 512] @ x.T
        d[np.arange(len(d)), np.arange(s, s + len(d))] = -np.inf
        part = np.argpartition(-d, wide - 1, axis=1)[:, :wide]
        vals = np.take_along_axis(d, part, 1)
        order = np.argsort(-vals, axis=1, kind="stable")
        near[s:s + 512], sim[s:s + 512] = np.take_along_axis(part, order, 1), np.take_along_axis(vals, order, 1)
    src, dst, val = [], [], []
    for s in range(0, n, 256):
        c, own = near[s:s + 256], sim[s:s + 256]
        between = np.einsum("ijd,ikd->ijk", x[c], x[c], optimize=True)
        keep = np.zeros(c.shape, bool)
        count = np.zeros(len(c), int)
        for j in range(wide):
            blocked = (keep[:, :j] & (between[:, j, :j] > own[:, j, None])).any(1)
            keep[:, j] = ~blocked & (count < links)
            count += keep[:, j]
        for j in range(wide):  # fill up with the nearest that were passed over
            more = ~keep[:, j] & (count < links)
            keep[:, j] |= more
            count += more
        rows, cols = np.nonzero(keep)
        src.append(rows + s)
        dst.append(c[rows, cols])
        val.append(own[rows, cols])
    a, b, v = np.concatenate(src), np.concatenate(dst), np.concatenate(val)
    a, b, v = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([v, v])
    _, first = np.unique(a.astype(np.int64) * n + b, return_index=True)
    a, b, v = a[first], b[first], v[first]
    order = np.lexsort((-v, a))
    a, b = a[order], b[order]
    start = np.searchsorted(a, np.arange(n))
    rank = np.arange(len(a)) - start[a]
    out = np.full((n, width), -1, np.int32)
    inside = rank < width
    out[a[inside], rank[inside]] = b[inside]
    return out


def build(vectors: np.ndarray, seed: int, links: int = LINKS) -> dict:
    """Graph of one shard: members of every layer (layer 0: all) and their neighbour arrays."""
    x = _lift(vectors)
    n = len(x)
    level = np.floor(-np.log(np.maximum(np.random.default_rng(seed).random(n), 1e-12)) / math.log(links)).astype(int)
    layers = []
    members = np.arange(n)
    depth = 0
    while True:
        layers.append((members.astype(np.int32), _layer(x[members], links)))
        if len(members) <= TOP_LAYER:
            break
        depth += 1
        above = np.flatnonzero(level >= depth)
        if not len(above):
            above = members[:1]
        if len(above) == len(members):
            break
        members = above
    return {"x": x, "layers": layers}


def search(graph: dict, queries: np.ndarray, beam: int = BEAM, k: int = K, floor: np.ndarray | None = None, widen: int = WIDEN) -> list[np.ndarray]:
    """For each query the rows of the nearest points found, best first.

    A query of whose k best one was met in the last quarter of its walk walks again with twice the beam, up to
    ``widen`` times the beam or all points. Points below a query's ``floor`` (an inner product) don't count for that.
    """
    out: list = [None] * len(queries)
    left, wide, most = np.arange(len(queries)), beam, min(beam * widen, graph["x"].shape[0])
    low = np.full(len(queries), -np.inf) if floor is None else floor
    while len(left):
        found, late = search_once(graph, queries[left], wide)
        for i, row in zip(left.tolist(), found):
            out[i] = row[row >= 0]
        if wide >= most:
            break
        val = (graph["points"][np.maximum(found[:, :k], 0)] * queries[left, None]).sum(2)
        left = left[((val >= low[left, None]) & late[:, :k] & (found[:, :k] >= 0)).any(1)]
        wide *= 2
    return out


def search_once(graph: dict, queries: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(queries, <= beam): rows of the nearest points found, best first, -1 where there are fewer, and whether each was
    met in the last quarter of the query's walk only."""
    x, layers = graph["x"], graph["layers"]
    q = np.hstack([_unit(queries), np.zeros((len(queries), 1))]).astype(np.float32)
    top = layers[-1][0]
    scores = q @ x[top].T
    width = min(8, len(top))
    entry = top[np.argpartition(-scores, width - 1, axis=1)[:, :width]]
    for depth in range(len(layers) - 1, -1, -1):
        members, links = layers[depth]
        local = np.full(len(x), -1, np.int32)
        local[members] = np.arange(len(members), dtype=np.int32)
        ef = min(len(members), beam if depth == 0 else 16)
        found, late = _walk(x[members], links, q, local[entry], ef)
        entry = np.where(found >= 0, members[np.maximum(found, 0)], -1)
        if depth:
            entry = entry[:, :8]
            entry = np.where(entry >= 0, entry, entry[:, :1])
    return entry, late


def _walk(x, links, q, start, ef) -> tuple[np.ndarray, np.ndarray]:
    """Beam walks of all queries in step; (queries, ef) rows of the best found, best first, and whether each was met in
    the last quarter of the query's steps (never if the beam holds all points)."""
    nq, n = len(q), len(x)
    seen = np.zeros((nq, n + 1), bool)
    seen[:, n] = True  # stands for "no neighbour"
    ids = np.full((nq, ef), n, np.int64)
    val = np.full((nq, ef), -np.inf, np.float32)
    done = np.ones((nq, ef), bool)
    met = np.zeros((nq, ef), np.int32)
    steps = np.zeros(nq, np.int32)

    def merge(at, new):
        r = at[:, None]
        new = np.sort(new, axis=1)
        new = np.where(np.hstack([np.zeros((len(new), 1), bool), new[:, 1:] == new[:, :-1]]), n, new)
        new = np.where(seen[r, new], n, new)
        seen[r, new] = True
        fresh = new < n  # most neighbours were met before: only the others are moved up and scored
        row, count = np.nonzero(fresh)[0], fresh.sum(1)
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        point = new[fresh]
        new = np.full((len(at), max(int(count.max(initial=0)), 1)), n, np.int64)
        new[row, place] = point
        score = np.full(new.shape, -np.inf, np.float32)
        for s in range(0, len(point), SCORED):
            part = slice(s, s + SCORED)
            score[row[part], place[part]] = np.einsum("pd,pd->p", np.take(q, at[row[part]], axis=0), np.take(x, point[part], axis=0))
        all_ids, all_val = np.hstack([ids[at], new]), np.hstack([val[at], score])
        all_done, all_met = np.hstack([done[at], new == n]), np.hstack([met[at], np.broadcast_to(steps[at, None], new.shape)])
        order = np.argpartition(-all_val, ef - 1, axis=1)[:, :ef]
        ids[at], val[at], done[at], met[at] = (np.take_along_axis(t, order, 1) for t in (all_ids, all_val, all_done, all_met))

    merge(np.arange(nq), start.astype(np.int64))
    active = np.arange(nq)
    wide = min(AT_ONCE, ef)
    while len(active):
        open_val = np.where(done[active], -np.inf, val[active])
        best = np.argpartition(-open_val, wide - 1, axis=1)[:, :wide]
        going = np.isfinite(np.take_along_axis(open_val, best, 1))
        left = going.any(1)
        active, best, going = active[left], best[left], going[left]
        if not len(active):
            break
        rows = active[:, None]
        done[rows, best] |= going
        new = links[np.where(going, ids[rows, best], 0)].astype(np.int64)
        steps[active] += 1
        merge(active, np.where((new < 0) | ~going[:, :, None], n, new).reshape(len(active), -1))
    order = np.argsort(-val, axis=1, kind="stable")
    out, met = np.take_along_axis(ids, order, 1), np.take_along_axis(met, order, 1)
    return np.where(out == n, -1, out), (4 * met > 3 * steps[:, None]) & (ef < n)


INDEX = "shard int, dim int, n int, points binary, reps binary, ids array<array<long>>, layers array<struct<members:binary,links:binary>>"


def build_index(points: DataFrame, shard_points: int = SHARD_POINTS) -> DataFrame:
    """One row per shard and dimension: the points and the layers' flat neighbour arrays. Each band of norms has shards
    of its own."""
    banded = points.withColumn("band", norm_band(F.col("v")))
    sizes = banded.groupBy("dim", "band").agg(F.count("*").alias("n")).orderBy("dim", "band").collect()  # at most 8,800 bands for each dimension
    if not sizes:
        return points.sparkSession.createDataFrame([], INDEX)
    parts, used = [], {}
    for r in sizes:
        n = -(-r["n"] // shard_points)
        parts.append((r["dim"], r["band"], used.get(r["dim"], 0), n))
        used[r["dim"]] = used.get(r["dim"], 0) + n
    parts = points.sparkSession.createDataFrame(parts, "dim int, band int, first_shard int, n_shards int")
    sharded = banded.join(F.broadcast(parts), ["dim", "band"]).withColumn("shard", (F.col("first_shard") + F.pmod(F.xxhash64("rep", F.lit(9)), F.col("n_shards"))).cast("int"))

    def one(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("rep")
        dim = t.column("dim")[0].as_py()
        v = t.column("v").chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        g = build(v, seed=11)
        row = {"shard": t.column("shard")[0].as_py(), "dim": dim, "n": len(v), "points": v.astype("<f8").tobytes(), "reps": t.column("rep").to_numpy().astype("<i8").tobytes(),
               "ids": t.column("ids").to_pylist(), "layers": [{"members": m.astype("<i4").tobytes(), "links": ls.astype("<i4").tobytes()} for m, ls in g["layers"]]}
        return pa.Table.from_pylist([row], schema=_INDEX)

    return with_python(sharded.select("shard", "dim", "rep", "v", "ids")).groupBy("shard", "dim").applyInArrow(one, INDEX)


_INDEX = pa.schema([("shard", pa.int32()), ("dim", pa.int32()), ("n", pa.int32()), ("points", pa.binary()), ("reps", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64()))),
                    ("layers", pa.list_(pa.struct([("members", pa.binary()), ("links", pa.binary())])))])


def nearest(table: DataFrame, is_query, k: int = K, shard_points: int = SHARD_POINTS, beam: int = BEAM, query_block: int = QUERY_BLOCK,
            id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest found of every query: query_id, rank (from 1), vec_id, score.

    ``is_query`` is a condition on vec_id. Candidates are all rows but those with the query's own id,
    of the same dimension. Vectors that are NULL, empty, zero or hold NULL or non-finite parts, and rows with a
    NULL id, take no part. Rows equal in id and vector count once. Ties go to the smaller id. Fewer
    than k candidates: all of them. An empty table gives no rows.
    """
    vectors = valid_vectors(table, id_col, vec_col)
    points = stage(points_of(vectors, k), "points")
    index = stage(build_index(points, shard_points), "index")
    queries = stage(vectors.where(is_query).distinct(), "queries")
    graphs = index.drop("n")
    blocks = max(1, math.ceil(queries.count() / query_block))
    dealt = queries.select("vec_id", "v", F.size("v").alias("dim"), F.lit(None).cast("double").alias("floor"), F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).alias("block"))
    first = stage(_walked(_blocks(dealt, "dim", "block").join(index.select("dim", "shard"), "dim").repartition("dim", "block", "shard"), graphs, 2 * beam, k, True), "found")

    ranked = first.select("query_id", "vec_id", "score").distinct().withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    floors = ranked.where(F.col("r") == k).select("query_id", F.col("score").alias("floor"))  # no such row: fewer than k found, no floor
    late = first.where("late").join(floors, "query_id", "left").where("floor IS NULL OR score >= floor").select(F.col("query_id").alias("vec_id"), "dim", "shard", "floor").distinct()
    again = late.join(queries.withColumn("dim", F.size("v")), ["vec_id", "dim"]).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)))
    second = _walked(_blocks(again, "dim", "block", "shard"), graphs, 4 * beam, k, False)

    found = first.drop("late", "dim", "shard").union(second.drop("late", "dim", "shard")).distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(queries: DataFrame, *keys: str) -> DataFrame:
    return queries.groupBy(*keys).agg(F.collect_list(F.struct("vec_id", "v", "floor")).alias("queries"))  # about query_block rows each


_FOUND = "query_id long, vec_id long, score double, dim int, shard int, late boolean"


def _walked(pairs: DataFrame, graphs: DataFrame, beam: int, k: int, once: bool) -> DataFrame:
    """The k best of every pair of a query and a shard. ``once``: a single walk, ``late`` marks points met in its last
    quarter. Else the beam widens for queries with such points at their floor or above, from ``beam`` to what ``WIDEN``
    allows for the first beam, a quarter of it."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("dim", pa.int32()), ("shard", pa.int32()), ("late", pa.bool_())])

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = {n: b.column(n)[i] for n in b.schema.names}
                dim, shard = r["dim"].as_py(), r["shard"].as_py()
                pts = np.frombuffer(r["points"].as_py(), "<f8").reshape(-1, dim)
                layers = []
                for lay in r["layers"].as_py():
                    m = np.frombuffer(lay["members"], "<i4")
                    layers.append((m, np.frombuffer(lay["links"], "<i4").reshape(len(m), -1)))
                ids = r["ids"].as_py()
                qs = r["queries"].as_py()
                qid = np.array([x["vec_id"] for x in qs], np.int64)
                qv = np.array([x["v"] for x in qs], np.float64).reshape(-1, dim)
                graph = {"x": _lift(pts), "points": pts, "layers": layers}
                if once:
                    got, late = search_once(graph, qv, beam)
                    got = [row[row >= 0] for row in got]
                else:
                    got = search(graph, qv, beam, k + 1, np.array([-np.inf if x["floor"] is None else x["floor"] for x in qs]), WIDEN // 4)
                    late = np.zeros((len(got), max(map(len, got))), bool)
                out = []
                for j, row in enumerate(got):
                    score = (pts[row] * qv[j]).sum(1)
                    best = sorted(((-s, v, new) for s, p, new in zip(score.tolist(), row.tolist(), late[j].tolist()) for v in ids[p] if v != qid[j]))[:k]
                    out += [(int(qid[j]), v, -s, dim, shard, new) for s, v, new in best]
                yield to_batch(out, schema)

    return with_python(pairs.join(graphs, ["dim", "shard"]).select("dim", "shard", "points", "ids", "layers", "queries")).mapInArrow(run, _FOUND)
