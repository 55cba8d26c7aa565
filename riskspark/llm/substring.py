"""Substring dedup by line hashing.

Units are lines, cut further after sentence ends (``.``, ``!``, ``?`` before a space or tab), each with
the white space behind it, so the units of a text join to the text. A unit is normalised (A-Z
lowered, runs of white space to one space, trimmed) and hashed to 128 bits. Of all occurrences of a
digest the one with the smallest (doc_id, place) stays; every other one is a repeat. Runs of
consecutive repeats of at least ``min_words`` words are removed; a shorter repeat is ordinary
language and stays. Offsets of what was removed refer to the original text.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import chunked, stage, with_python

#: Words in a run of repeats from which it is removed.
MIN_WORDS = 25
_CUT = re.compile(r"(?<=[.!?])[ \t]+|\n+")


def units_of(text: str) -> list[tuple[int, int]]:
    """(start, end) of every unit, gapless."""
    cuts = [m.end() for m in _CUT.finditer(text)]
    if not cuts or cuts[-1] != len(text):
        cuts.append(len(text))
    return list(zip([0, *cuts], cuts)) if text else []


def normal(unit: str) -> bytes:
    return b" ".join(unit.encode().lower().split())  # bytes: only A-Z are lowered, only ASCII white space splits


def runs(repeat: list[bool], words: list[int], min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Maximal runs (first, end) of repeats that hold at least ``min_words`` words."""
    out, i = [], 0
    while i < len(repeat):
        j = i
        while j < len(repeat) and repeat[j]:
            j += 1
        if j > i and sum(words[i:j]) >= min_words:
            out.append((i, j))
        i = j + 1
    return out


def hash_units(docs: DataFrame) -> DataFrame:
    """(doc_id, uid, place, hi, lo) of every unit that isn't blank. docs: (doc_id, uid, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("place", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64())])

    def rows(batches):
        digest = xxhash.xxh3_128_digest
        for b in batches:
            for d, u, t in zip(*(c.to_pylist() for c in b.columns)):
                for k, (x, y) in enumerate(units_of(t or "")):
                    if unit := normal(t[x:y]):
                        h = digest(unit)
                        yield d, u, k, int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)

    return with_python(docs.select("doc_id", "uid", "text")).mapInArrow(lambda bs: chunked(rows(bs), schema, max_rows=1 << 16), "doc_id long, uid long, place int, hi long, lo long")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every column and row of ``docs`` with the repeats cut from the text, plus ``removed``: an array of
    (start, end) in code points of the original text.

    Rows equal in doc_id and text are one document: they count once and get the same result. A NULL
    doc_id ranks first. NULL and empty texts stay as they are; a text of repeats only becomes empty.
    Blank units end a run. A column called ``removed`` is replaced. An empty table gives no rows.
    """
    base = docs.drop("removed")
    ident = [F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("uid"), F.col(text_col).cast("string").alias("text")]
    units = stage(hash_units(docs.select(*ident)), "units")
    at = F.struct("doc_id", "uid", "place")
    # written first: the join's two sides are then plain, and a digest with very many places can be split
    ranked = stage(units.groupBy("hi", "lo").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("NOT (first <=> last)").select("hi", "lo", "first"), "repeats")
    repeats = (units.join(ranked, ["hi", "lo"]).where(~at.eqNullSafe(F.col("first")))
               .groupBy("doc_id", "uid").agg(F.collect_set("place").alias("places")))
    names = [f"c{i}" for i in range(len(base.columns))]
    left = base.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(base.columns, names)], *[c.alias(f"__{n}") for c, n in zip(ident[:2], ("doc_id", "uid"))])
    joined = left.join(repeats.select(F.col("doc_id").alias("__d"), F.col("uid").alias("__u"), "places"),
                       F.col("__doc_id").eqNullSafe(F.col("__d")) & (F.col("__uid") == F.col("__u")), "left").drop("__d", "__u", "__doc_id", "__uid")
    text_at = base.columns.index(text_col)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def cut(text, places):
        spans = units_of(text)
        hit = set(places)
        flags = [k in hit for k in range(len(spans))]
        gone = [(spans[i][0], spans[j - 1][1]) for i, j in runs(flags, [len(normal(text[a:b]).split()) if f else 0 for f, (a, b) in zip(flags, spans)], min_words)]
        kept, last = [], 0
        for a, b in gone:
            kept.append(text[last:a])
            last = b
        return "".join([*kept, text[last:]]), [{"start": a, "end": b} for a, b in gone]

    def run(batches):
        for b in batches:
            texts, places = b.column(text_at).to_pylist(), b.column(len(names)).to_pylist()
            got = [cut(t, p) if t and p else (t, []) for t, p in zip(texts, places)]
            cols = list(b.columns[:-1])
            cols[text_at] = pa.array([t for t, _ in got], type=pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array([r for _, r in got], type=pa.list_(span))], names=[*names, "removed"])

    ddl = ", ".join([*(f"{n} {'string' if i == text_at else f.dataType.simpleString()}" for i, (n, f) in enumerate(zip(names, base.schema.fields))), "removed array<struct<start:int,end:int>>"])
    out = with_python(joined).mapInArrow(run, ddl)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, base.columns)], "removed")
