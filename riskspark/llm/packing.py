"""Space-filling-curve packing of tokenized documents into sequences of a fixed length.

Each document becomes a hashed bag-of-tokens vector, projected to a few dimensions; the Hilbert key
of the projected point is its place on the curve. Documents are range-sorted by (key, doc_id), so
neighbours on the curve lie next to each other, and the token stream in that order is cut at every
``length`` tokens. So only the very last sequence can be short, and it is split at powers of two:
no token of padding is left at all.
"""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm import tokens
from riskspark.llm.common import chunked, stage, with_python

LENGTH = 2048
END_ID = 1
HASH_DIMS, DIMS, BITS = 256, 4, 15
PARTITION_TOKENS = 16 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@functools.lru_cache(maxsize=2)
def projection(dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket of every id, and the random projection of the buckets."""
    ids = np.arange(1 << 16, dtype=np.uint64)
    bucket = ((ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.int64) % HASH_DIMS
    return bucket, np.random.default_rng(7).standard_normal((HASH_DIMS, dims))


def project(docs: list[np.ndarray], dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    """(documents, dims) grid points: hashed counts, dampened and normalised, projected, spread evenly."""
    bucket, matrix = projection(dims)
    place = np.repeat(np.arange(len(docs)) * HASH_DIMS, [len(d) for d in docs])
    flat = np.concatenate([*docs, np.zeros(0, dtype="<u2")])
    counts = np.log1p(np.bincount(place + bucket[flat], minlength=len(docs) * HASH_DIMS).reshape(len(docs), HASH_DIMS))
    size = np.sqrt((counts * counts).sum(1, keepdims=True))
    point = counts / np.maximum(size, 1e-300) @ matrix
    even = 1 / (1 + np.exp(-1.702 * point))  # close to the normal distribution
    return np.minimum((1 << bits) - 1, (even * (1 << bits)).astype(np.int64))


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of grid points on the Hilbert curve: a Gray-code walk from the top bit down."""
    x = [points[:, i].copy() for i in range(points.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[n - 1] & q, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | ((x[i] ^ turn) >> b) & 1
    return key


def tokenize(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, doc_id, key, n, ids): ids with the end id, little-endian unsigned 16-bit. uid is unique."""
    path = tokenizer or default_tokenizer()
    end = np.array([END_ID], dtype="<u2").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def rows(batches):
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                got = tokens.encode(part.column(1).to_pylist(), path)
                keys = hilbert_keys(project([np.frombuffer(raw, "<u2") for raw in got])).tolist()
                for d, key, raw in zip(part.column(0).to_pylist(), keys, got):
                    yield d, key, len(raw) // 2 + 1, raw + end

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = with_python(src).mapInArrow(lambda bs: chunked(rows(bs), schema, weigh=lambda r: len(r[3])), "doc_id long, key long, n long, ids binary")
    return out.withColumn("uid", F.monotonically_increasing_id())


def place(marked: DataFrame) -> DataFrame:
    """(uid, start): the first token's place in the stream along the curve.

    Only (uid, key, doc_id, n) is range-sorted. Each partition's running sum starts at zero; the
    partitions' own offsets come from one row per partition.
    """
    narrow = marked.select("uid", "key", "doc_id", "n")
    total = narrow.agg(F.sum("n")).first()[0] or 0
    parts = max(1, math.ceil(total / PARTITION_TOKENS))
    local = pa.schema([("uid", pa.int64()), ("part", pa.int32()), ("local", pa.int64()), ("n", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column("n").to_numpy()
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n), b.column("n")], schema=local)
            at = int(ends[-1]) if len(n) else at

    ordered = narrow.repartitionByRange(parts, "key", "doc_id", "uid").sortWithinPartitions("key", "doc_id", "uid")
    placed = stage(with_python(ordered).mapInArrow(run, "uid long, part int, local long, n long"), "places")
    sizes = placed.groupBy("part").agg(F.sum("n").alias("size"))  # a row for each partition
    base = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("base"))
    return placed.join(F.broadcast(base), "part").select("uid", (F.col("base") + F.col("local")).alias("start")), total


def pieces_of(start: int, n: int, total: int, length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """(start in the document, length, sequence, offset) of each piece of the n tokens at ``start``."""
    full = total // length * length
    cuts = [full]  # the rest of the stream, in falling powers of two
    rest = total - full
    for b in range(length.bit_length(), -1, -1):
        if rest >> b & 1:
            cuts.append(cuts[-1] + (1 << b))
    out, at = [], start
    while at < start + n:
        if at < full:
            seq, begin, end = at // length, at // length * length, at // length * length + length
        else:
            k = max(i for i, c in enumerate(cuts) if c <= at)
            seq, begin, end = full // length + k, cuts[k], cuts[k + 1]
        size = min(end, start + n) - at
        out.append((at - start, size, seq, at - begin))
        at += size
    return out


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve_key, ids.

    A NULL or empty text has only the end id. Repeated rows and rows with a NULL doc_id are packed
    each on their own. Equal keys are ordered by doc_id, then by row. Other columns are not read. An
    empty table gives no rows. ``ids`` are little-endian unsigned 32-bit.
    """
    marked = stage(tokenize(docs, tokenizer, id_col, text_col), "tokens")
    placed, total = place(marked)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
                        ("sequence_id", pa.int64()), ("offset", pa.int64()), ("curve_key", pa.int64()), ("ids", pa.binary())])

    def rows(batches):
        for b in batches:
            for d, key, n, raw, start in zip(*(b.column(c).to_pylist() for c in ("doc_id", "key", "n", "ids", "start"))):
                ids = np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                for at, size, seq, off in pieces_of(start, n, total, length):
                    part = ids[4 * at:4 * (at + size)]
                    yield d, at, size, zlib.crc32(part), n, seq, off, key, part

    both = marked.join(placed, "uid").select("doc_id", "key", "n", "ids", "start")
    return with_python(both).mapInArrow(lambda bs: chunked(rows(bs), schema, weigh=lambda r: len(r[8])),
                                        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve_key long, ids binary")
