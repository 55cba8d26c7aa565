"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints are collapsed to distinct values first, so a group of exact copies is one value. Then
every fingerprint emits the variants of itself within half the radius and one shuffle brings equal
variants together. For an odd radius r = 2h + 1 two balls of radius h miss the pairs that are exactly
r bits apart. Those pairs differ in parity, so only fingerprints of odd parity emit variants of
radius h + 1, and of these only the ones whose changed bits all lie in one half of the word: of the
2h + 1 differing bits one half always holds h + 1. Any two members of a variant's bucket, one of
them within h of it, are thus within r bits, so a bucket needs no list of its pairs: every member is
linked (and checked) against the bucket's first one. Nothing is lost and a bucket of n members
gives n - 1 links. The links' components are found by star contraction.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.common import components, raw_strings, stage, with_python

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text. No words (or NULL): zero."""
    words = (text or b"").lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return 0
    if len(words) <= shingle_words:
        shingles = [b" ".join(words)]
    else:
        flat = b" ".join(words)
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        shingles = [flat[a:b - 1] for a, b in zip(starts, ends[shingle_words - 1:])]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8", count=len(shingles))
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i:i + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text",
                     keep: list[str] | None = None) -> DataFrame:
    """(doc_id, fp) of every row, and the columns of ``docs`` that ``keep`` names (other names than these)."""
    kept = docs.select(*(keep or [])).schema
    inner = [f"k{i}" for i in range(len(kept))]

    def run(batches):
        for b in batches:
            fps = [fingerprint(t, shingle_words) for t in raw_strings(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, type=pa.int64()), *b.columns[2:]], ["doc_id", "fp", *inner])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(f"`{c}`").alias(k) for c, k in zip(kept.names, inner)])
    types = ", ".join(["doc_id long, fp long", *(f"{k} {f.dataType.simpleString()}" for k, f in zip(inner, kept))])
    return with_python(src).mapInArrow(run, types).withColumnsRenamed(dict(zip(inner, kept.names)))


def ball_masks(max_bits: int) -> tuple[list[int], list[int]]:
    """(variants of every fingerprint, further variants of those of odd parity), as signed longs."""
    half = max_bits // 2

    def flips(bits, size):
        return [sum(1 << b for b in c) for c in combinations(bits, size)]

    own = [m for size in range(half + 1) for m in flips(range(64), size)]
    more = flips(range(32), half + 1) + flips(range(32, 64), half + 1) if max_bits % 2 else []
    signed = lambda ms: [m - (1 << 64) if m >> 63 else m for m in ms]
    return signed(own), signed(more)


def ball_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) whose components are those of "differ in at most ``max_bits`` bits". fps: distinct (fp)."""
    half = max_bits // 2
    own, more = ball_masks(max_bits)
    # a row becomes hundreds: deal the few fingerprints of a small file over all tasks first
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    masks = F.lit(own) if not more else F.when(F.bit_count("fp") % 2 == 1, F.lit(own + more)).otherwise(F.lit(own))
    variants = fps.select("fp", F.explode(masks).alias("m")).select(F.col("fp").bitwiseXOR(F.col("m")).alias("z"), "fp")
    away = F.bit_count(F.col("z").bitwiseXOR(F.col("fp")))
    bucket = Window.partitionBy("z").orderBy(away > half, "fp")
    first = variants.select("fp", F.first("fp").over(bucket).alias("b"), F.first(away).over(bucket).alias("d"))
    return (first.where((F.col("d") <= half) & (F.col("fp") != F.col("b")))
            .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= max_bits)
            .select(F.col("fp").alias("a"), "b").distinct())


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                    id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (long), component_id, root (long), and the columns that ``keep`` names.

    component_id is the smallest doc_id that can be reached over fingerprints that differ in at most
    ``max_bits`` bits, the row's own included; root is the smallest fingerprint of the component, the
    same for all its rows and no others. A NULL text has no words: fingerprint zero, linked like
    any other. A NULL doc_id is ignored by the minimum (NULL only where a component has no other id).
    Repeated rows stay repeated. Other columns are not read. An empty table gives no rows.
    """
    marked = stage(with_fingerprint(docs, shingle_words, id_col, text_col, keep), "fingerprints")
    low = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "fingerprint-low")
    roots = components(ball_links(low.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    rooted = low.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    member = rooted.join(first, "root").select("fp", "component_id", "root")
    return marked.join(member, "fp").select("doc_id", "fp", "component_id", "root", *(keep or []))


def fp_hex(column="fp"):
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")
