"""Prefix trie of conversations from sorted neighbours and range minima.

Every conversation becomes a key: one 16-byte digest per turn, each over the turn and the digest before it, so
equal digests at a depth mean equal prefixes. Conversations are range-sorted by key into blocks. In a block the
longest common prefixes (LCPs) of neighbours stand in a sparse table of range minima. Candidate prefixes are each
row's whole key and its LCP with the row before; each one binary-searches the table to the left and to the right
for the nearest LCP below its depth, independently of all others, and gets the interval of its members without a
stack. Member counts, leaves and token sums of an interval are differences of running sums, its smallest member
is a range minimum again.

Prefixes that reach over a block's end are shared by the two rows at that border, so there are at most as many
as the LCP there. The block where such an interval begins finds the block where it ends with a second sparse table
over the blocks' minima (a few numbers for each of at most ``MAX_BLOCKS`` blocks, broadcast); the part in the last
block comes by a join on (block, depth).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.common import stage, with_python

#: Conversations and key bytes that a block holds on average, and most blocks (the broadcast's bound).
BLOCK_ROWS, BLOCK_BYTES, MAX_BLOCKS = 1 << 15, 64 << 20, 1 << 14
WORD = r"[^\x20\x09-\x0D]+"
_SIZE = 16
_TURNS = "array<struct<digest:binary,words:bigint>>"


class SparseTable:
    """Minima of all ranges whose length is a power of two."""

    def __init__(self, values: np.ndarray):
        self.levels, k = [values], 1
        while 2 * k <= len(values):
            low = self.levels[-1]
            self.levels.append(np.minimum(low[:-k], low[k:]))
            k *= 2
        self.n = len(values)

    def first_below(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Smallest index >= start with a value < bound; n if there is none."""
        at = start.astype(np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            go = at + (1 << k) <= self.n
            go &= level[np.minimum(at, len(level) - 1)] >= bound
            at = at + (go.astype(np.int64) << k)
        return at

    def last_below(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Largest index <= start with a value < bound; -1 if there is none."""
        at = start.astype(np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            low = at - (1 << k) + 1
            go = (low >= 0) & (self.levels[k][np.maximum(low, 0)] >= bound)
            at = at - (go.astype(np.int64) << k)
        return at

    def minimum(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of lo..hi, both included, lo <= hi."""
        out = np.empty(len(lo), dtype=self.levels[0].dtype)
        k = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        for x in np.unique(k):
            m = k == x
            out[m] = np.minimum(self.levels[x][lo[m]], self.levels[x][hi[m] - (1 << int(x)) + 1])
        return out


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): digest and word count of every turn, in order of turn (NULL first), role, text.

    NULL role or text: empty. Rows without a conv_id belong to no conversation. Texts are not gathered.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    one = F.struct(place.alias("place"), digest.alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    held = F.sort_array(F.collect_list("one"))
    return rows.select("conv_id", one.alias("one")).groupBy("conv_id").agg(F.transform(held, lambda t: F.struct(t["digest"], t["words"])).alias("turns"))


def graft(convs: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Every conversation c with its first h turns replaced by those of conversation c - c % ``family`` (as many
    as there are), h = crc32 of c in decimal, modulo ``most``."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = convs.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    joined = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(heads, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), h), F.array().cast(_TURNS))
    return joined.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def keys_of(convs: DataFrame) -> DataFrame:
    """(conv_id, key, words): the chained digests of every conversation as one binary value."""

    def run(batches):
        for b in batches:
            digests, words = b.column(1), b.column(2)
            keys = []
            for own in digests.to_pylist():
                last, parts = b"", []
                for d in own:
                    last = hashlib.md5(last + d).digest()
                    parts.append(last)
                keys.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), words], ["conv_id", "key", "words"])

    flat = convs.select("conv_id", F.transform("turns", lambda t: t["digest"]).alias("digests"), F.transform("turns", lambda t: t["words"]).alias("words"))
    return with_python(flat).mapInArrow(run, "conv_id long, key binary, words array<long>")


def _common(a: bytes, b: bytes) -> int:
    """Leading digests that two keys share."""
    n = min(len(a), len(b)) // _SIZE
    x, y = (np.frombuffer(k, dtype="V16", count=n) for k in (a, b))
    differ = np.flatnonzero(x != y)
    return int(differ[0]) if len(differ) else n


class _Block:
    """The rows of one block in order, with their LCPs; ``left`` and ``right`` are the LCPs at its borders."""

    def __init__(self, t: pa.Table, left: int = -1, right: int = -1):
        t = t.take(pc.sort_indices(t["at"])).combine_chunks()
        self.n = len(t)
        self.conv = t["conv_id"].to_numpy().astype(np.int64)
        self.keys = t["key"].combine_chunks() if isinstance(t["key"], pa.ChunkedArray) else t["key"]
        size = pc.binary_length(self.keys).to_numpy(zero_copy_only=False).astype(np.int64) // _SIZE
        self.size, self.first = size, np.concatenate([[0], np.cumsum(size)])
        self.elements = np.frombuffer(b"".join(self.keys.to_pylist()), dtype="<u8").reshape(-1, 2)
        words = pc.list_flatten(t["words"].combine_chunks() if isinstance(t["words"], pa.ChunkedArray) else t["words"]).to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = np.concatenate([[0], np.cumsum(words)])
        shared = np.minimum(size[:-1], size[1:])
        pair = np.repeat(np.arange(self.n - 1), shared)
        step = np.arange(len(pair)) - np.repeat(np.cumsum(shared) - shared, shared)
        same = (self.elements[self.first[pair] + step] == self.elements[self.first[pair + 1] + step]).all(1)  # chained: equal only up to the LCP
        inner = np.bincount(pair[same], minlength=self.n - 1).astype(np.int64) if self.n > 1 else np.zeros(0, np.int64)
        self.lcp = np.concatenate([[left], inner, [right]])
        self.inner = int(inner.min()) if len(inner) else 1 << 40
        every = np.arange(self.n)
        self.leaf = np.concatenate([[0], np.cumsum(self.lcp[1:] < size)])
        self.shared = np.concatenate([[0], np.cumsum(self.tokens(every, np.maximum(self.lcp[:-1], 0)))])

    def tokens(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Words of a row's first ``depth`` turns."""
        return self.words[self.first[row] + depth] - self.words[self.first[row]]

    def digest(self, row: int, depth: int) -> bytes:
        return self.elements[self.first[row] + depth - 1].tobytes() if depth else b""


_SUMMARY = "pid long, n long, first binary, last binary, first_words array<long>, inner long, conv_id long, leaves long, shared long"
_FOUND = ("kind string, pid long, depth long, digest binary, parent binary, conv_id long, parent_conv_id long, n_convs long, "
          "n_children long, n_leaves long, tokens long, base long, ends string")


def _summary(t: pa.Table) -> pa.Table:
    b = _Block(t)
    row = (t["pid"][0].as_py(), b.n, b.keys[0].as_py(), b.keys[-1].as_py(), np.diff(b.words[:b.first[1] + 1]).tolist(), b.inner, int(b.conv.min()),
           int(b.leaf[b.n - 1]), int(b.shared[b.n] - b.shared[1]))
    return _table([row], _SUMMARY)


def _types(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (x.strip().split(" ") for x in ddl.split(","))])


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    schema = _types(ddl)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else schema.empty_table()


def _borders(batches):
    """LCPs at a block's ends, and its sums with the first row's shared words and the last row's leaf."""
    for b in batches:
        rows = []
        for r in b.to_pylist():
            left = -1 if r["before"] is None else _common(r["before"], r["first"])
            right = -1 if r["after"] is None else _common(r["last"], r["after"])
            rows.append((r["pid"], r["n"], r["inner"], r["conv_id"], left, right, r["leaves"] + (right < len(r["last"]) // _SIZE), r["shared"] + sum(r["first_words"][:max(left, 0)])))
        yield from _table(rows, _BLOCKS).to_batches()


_BLOCKS = "pid long, n long, inner long, conv_id long, left long, right long, leaves long, shared long"


def _ids(conv: np.ndarray) -> str:
    return ",".join(map(str, conv.tolist()))


def _resolve(t: pa.Table, blocks: dict[str, np.ndarray], ends: SparseTable, smallest: SparseTable) -> pa.Table:
    """Nodes of one block, and the parts of those that reach over its borders (kinds of _FOUND)."""
    pid = t["pid"][0].as_py()
    own = int(np.searchsorted(blocks["pid"], pid))
    b = _Block(t, int(blocks["left"][own]), int(blocks["right"][own]))
    lcp, n, conv = SparseTable(b.lcp), b.n, SparseTable(b.conv)
    left_of = lambda row, depth: lcp.last_below(row, depth)
    right_of = lambda row, depth: lcp.first_below(row + 1, depth) - 1  # noqa: E731  n: beyond the block
    every = np.arange(n)
    inside = every[b.lcp[:-1] >= 0]
    row, depth = np.concatenate([inside, every]), np.concatenate([b.lcp[inside], b.size])
    whole = np.arange(len(row)) >= len(inside)  # the candidate is a row's whole key
    lo, hi = left_of(row, depth), right_of(row, depth)
    here = (lo >= 0) & (hi < n)
    out: list[pa.Table] = []

    _, pick, which = np.unique(lo[here] * (n + 1) + hi[here], return_index=True, return_inverse=True)
    lo_n, hi_n, deep = lo[here][pick], hi[here][pick], depth[here][pick]
    done = np.bincount(which[whole[here]], minlength=len(pick))
    children = np.bincount(which[~whole[here]], minlength=len(pick)) + 1 - done
    up = np.maximum(b.lcp[lo_n], b.lcp[hi_n + 1])
    first, last = left_of(lo_n, up), right_of(lo_n, up)
    smallest_own = conv.minimum(lo_n, hi_n)
    known = (up >= 0) & (first >= 0) & (last < n)
    above = np.zeros(len(pick), dtype=np.int64)
    above[known] = conv.minimum(first[known], last[known])
    parents = [None if u < 0 or k else b.digest(i, u) for u, k, i in zip(up.tolist(), known.tolist(), lo_n.tolist())]
    empty = hashlib.sha256(b"").hexdigest()
    shas = [hashlib.sha256(_ids(b.conv[i:i + m]).encode()).hexdigest() if m else empty for i, m in zip(lo_n.tolist(), done.tolist())]
    node = np.repeat(np.arange(len(pick)), deep - up)  # a node for each depth of the edge above the interval
    at = np.arange(len(node)) - np.repeat(np.cumsum(deep - up) - (deep - up), deep - up)
    d = up[node] + 1 + at
    lowest = d == deep[node]
    count = hi_n[node] - lo_n[node] + 1
    saved = b.shared[hi_n[node] + 1] - b.shared[lo_n[node] + 1] - (count - 1) * b.tokens(lo_n[node], np.maximum(d - 1, 0))
    shas_at, parents_at = pa.array(shas, pa.string()), pa.array(parents, pa.binary())
    no = pa.nulls(len(node), pa.int64())
    out.append(pa.Table.from_arrays([
        pa.array(["node"] * len(node), pa.string()), pa.array(np.full(len(node), pid)), pa.array(d), pa.nulls(len(node), pa.binary()),
        pc.if_else(pa.array(at == 0), parents_at.take(pa.array(node)), pa.scalar(None, pa.binary())), pa.array(smallest_own[node]),
        pa.array(np.where(at == 0, above[node], smallest_own[node]), mask=(at == 0) & ~known[node]), pa.array(count),
        pa.array(np.where(lowest, children[node], 1)), pa.array(b.leaf[hi_n[node] + 1] - b.leaf[lo_n[node]]), pa.array(saved), no,
        pc.if_else(pa.array(lowest), shas_at.take(pa.array(node)), pa.scalar(empty))], schema=_types(_FOUND)))

    rows: list[tuple] = []
    over = np.arange(b.lcp[n] + 1)  # prefixes shared with the next block
    lo = left_of(np.full(len(over), n - 1), over)
    for x, i in zip(over[lo >= 0].tolist(), lo[lo >= 0].tolist()):
        end = int(ends.first_below(np.array([own + 1]), np.array([x]))[0])
        mid = slice(own + 1, end)
        low = int(b.conv[i:].min()) if end == own + 1 else min(int(b.conv[i:].min()), int(smallest.minimum(np.array([own + 1]), np.array([end - 1]))[0]))
        rows.append(("tail", int(blocks["pid"][end]), x, b.digest(n - 1, x), b.digest(n - 1, x - 1) if x else None, low, None, n - i + int(blocks["n"][mid].sum()), None,
                     int(b.leaf[n] - b.leaf[i] + blocks["leaves"][mid].sum()), int(b.shared[n] - b.shared[i + 1] + blocks["shared"][mid].sum()),
                     int(b.tokens(np.array([n - 1]), np.array([max(x - 1, 0)]))[0]), None))
    over = np.arange(b.lcp[0] + 1)  # prefixes shared with the block before
    hi = right_of(np.zeros(len(over), dtype=np.int64), over)
    for x, j in zip(over[hi < n].tolist(), hi[hi < n].tolist()):
        rows.append(("head", pid, x, None, None, int(b.conv[:j + 1].min()), None, j + 1, None, int(b.leaf[j + 1]), int(b.shared[j + 1]), None, None))
    # candidates of prefixes that cross a border: they hold the border row's prefix, so depth and side name them
    far_row, far_depth, far_whole, side = row[~here], depth[~here], whole[~here], (left_of(row[~here], depth[~here]) >= 0).astype(np.int64)
    named, which = np.unique(far_depth * 2 + side, return_inverse=True)
    for k, x in enumerate(named.tolist()):
        mine = which == k
        enders = np.sort(far_row[mine & far_whole])
        digest = b.digest(n - 1 if x & 1 else 0, x >> 1)
        rows.append(("part", pid, x >> 1, digest, None, None, None, None, int(mine.sum()) - 2 * len(enders), None, None, None, _ids(b.conv[enders]) if len(enders) else None))
    out.append(_table(rows, _FOUND))
    return pa.concat_tables(out)


def _stream_digests(batches):
    """One SHA-256 per digest over its parts in order of block, comma-joined; rows come sorted, no list is held."""
    last, state, rows = None, None, []
    for b in batches:
        for digest, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if digest != last:
                if last is not None:
                    rows.append((last, state.hexdigest()))
                last, state = digest, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if last is not None:
        rows.append((last, state.hexdigest()))
    yield from _table(rows, "digest binary, sha string").to_batches()


def prefix_trie(convs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every node of the trie of ``convs`` (conv_id unique, turns: array of (digest, words)): conv_id (smallest member),
    depth, parent_conv_id (NULL for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations without turns are members of the root only. Equal conversations end at the same node. No
    conversations: no rows, not even the root. One conversation's key (16 bytes a turn) is one value.
    """
    spark = convs.sparkSession
    keyed = stage(keys_of(convs), "trie-keys")
    n, size = keyed.agg(F.count("*"), F.sum(F.octet_length("key"))).first()
    spread = min(-(-n // 1024), spark.sparkContext.defaultParallelism)
    blocks = max(1, min(MAX_BLOCKS, max(-(-n // block_rows), -(-(size or 0) // BLOCK_BYTES), spread)))
    ordered = keyed.repartitionByRange(blocks, "key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn("at", F.monotonically_increasing_id())
    ordered = stage(ordered.withColumn("pid", F.shiftright("at", 33)), "trie-sorted")
    ends = with_python(ordered).groupBy("pid").applyInArrow(_summary, _SUMMARY)
    near = Window.orderBy("pid")  # at most MAX_BLOCKS rows
    known = ends.withColumns({"before": F.lag("last").over(near), "after": F.lead("first").over(near)}).mapInArrow(_borders, _BLOCKS).orderBy("pid").toPandas()
    held = spark.sparkContext.broadcast({c: known[c].to_numpy(dtype=np.int64) for c in known.columns})

    def resolve(t: pa.Table) -> pa.Table:
        block = held.value
        return _resolve(t, block, SparseTable(np.minimum(block["inner"], block["right"])), SparseTable(block["conv_id"]))

    found = stage(with_python(ordered).groupBy("pid").applyInArrow(resolve, _FOUND), "trie-parts")
    heads = found.where("kind = 'head'").select("pid", "depth", *[F.col(c).alias(f"h_{c}") for c in ("conv_id", "n_convs", "n_leaves", "tokens")])
    parts = found.where("kind = 'part'")
    extra = parts.groupBy("digest").agg(F.sum("n_children").alias("more"))
    # pieces of a hot run pass one task in order, one row each: a digest of a list can't be split
    runs = parts.where("ends IS NOT NULL").select("digest", "ends", "pid").repartition("digest").sortWithinPartitions("digest", "pid").mapInArrow(_stream_digests, "digest binary, sha string")
    wide = found.where("kind = 'tail'").join(heads, ["pid", "depth"], "left").join(extra, "digest", "left").join(runs, "digest", "left")
    count = F.col("n_convs") + F.col("h_n_convs")
    wide = wide.select("digest", "parent", "depth", F.least("conv_id", "h_conv_id").alias("conv_id"), count.alias("n_convs"), (F.coalesce("more", F.lit(0)) + 1).alias("n_children"),
                       (F.col("n_leaves") + F.col("h_n_leaves")).alias("n_leaves"), (F.col("tokens") + F.col("h_tokens") - (count - 1) * F.col("base")).alias("saved_tokens"),
                       F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
    wide = stage(wide, "trie-wide")
    names = wide.select(F.col("digest").alias("parent"), F.col("conv_id").alias("above"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = found.where("kind = 'node'").withColumnsRenamed({"tokens": "saved_tokens", "ends": "ends_sha256"})
    nodes = nodes.join(names, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return nodes.select(*out).unionByName(wide.join(names, "parent", "left").withColumn("parent_conv_id", F.col("above")).select(*out))
