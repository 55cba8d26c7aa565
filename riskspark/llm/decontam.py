"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are the windows of ``window`` consecutive words of every benchmark item; an item with fewer
words is one shorter window. Windows of one length share a search: a shift table over blocks of two
words skips positions where no window can end, a zero shift leads to the bucket of the windows that
end in this block, and a direct comparison confirms an occurrence. The items are read in blocks of a
bounded size and searched a few blocks a pass; the hits so far travel with the documents, so neither the driver nor an
executor ever holds more than one pass's blocks, however many items there are.
"""

from __future__ import annotations

import collections
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import raw_strings, stage, to_batch, with_python

WINDOW = 10
BLOCK_BYTES = 2 << 20
#: Blocks of items that one pass over the documents searches (what is broadcast at once: BLOCKS * BLOCK_BYTES of text).
BLOCKS = 4
#: Text of documents that is searched for one block of items before the next block's turn: with more
#: blocks than a worker keeps tables, they are built anew once for this much text.
SLICE_BYTES = 8 << 20
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased; runs of anything but ASCII controls, space, punctuation and symbols."""
    return _WORDS.findall((text or b"").lower())


class Search:
    """Shift and bucket tables of the windows of one length."""

    def __init__(self, size: int):
        self.size, self.block = size, min(2, size)
        self.default = size - self.block + 1
        self.items: dict[tuple, set[str]] = {}
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, set[tuple]] = {}
        self.last: set[bytes] = set()

    def add(self, window: tuple, item: str | None) -> None:
        known = self.items.get(window)
        if known is None:
            known = self.items[window] = set()
            for end in range(self.block, self.size + 1):
                key = window[end - self.block:end]
                self.shift[key] = min(self.shift.get(key, self.default), self.size - end)
                self.last.add(key[-1])
            self.bucket.setdefault(window[-self.block:], set()).add(window)
        if item is not None:
            known.add(item)

    def find(self, words: list[bytes], spans: list[tuple[int, int]], found: set[str]) -> None:
        size, block, default, last = self.size, self.block, self.default, self.last
        shift, bucket, i, n = self.shift, self.bucket, self.size, len(words)
        while i <= n:
            if words[i - 1] not in last:
                i += default
                continue
            key = tuple(words[i - block:i])
            step = shift.get(key, default)
            if step:
                i += step
                continue
            here = tuple(words[i - size:i])
            if here in bucket[key]:  # compared word by word with the bucket's windows of equal hash
                spans.append((i - size, i))
                found |= self.items[here]
            i += 1


def searches_of(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> list[Search]:
    by_size: dict[int, Search] = {}
    for item, text in items:
        words = words_of(text.encode() if text else None)
        size = min(window, len(words))
        if size:
            search = by_size.setdefault(size, Search(size))
            for i in range(len(words) - size + 1):
                search.add(tuple(words[i:i + size]), item)
    return list(by_size.values())


_TABLES: collections.OrderedDict[tuple, list[Search]] = collections.OrderedDict()


def tables_of(key: tuple, holder, window: int) -> list[Search]:
    """The tables of one block of items; a Python worker keeps the last few."""
    if key not in _TABLES:
        _TABLES[key] = searches_of(holder.value, window)
        while len(_TABLES) > 4:
            _TABLES.popitem(last=False)
    return _TABLES[key]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The items in blocks of about ``block_bytes`` of text, one at a time on the driver."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, r.text) for r in part.collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text",
               keep: list[str] | None = None, slice_bytes: int = SLICE_BYTES, blocks: int = BLOCKS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, spans (array of start, end in words), items (sorted).

    A NULL text has no words. An item without words has no window; repeated items count once; a NULL
    item_id marks words but is not listed. Windows never cross documents. ``keep`` names columns of
    ``docs`` to return as well (first). Empty tables: no rows, or no hits. With more than ``blocks`` blocks of items the
    documents are read once for each ``blocks`` of them, the hits so far written beside them in between.
    """
    kept = docs.select(*[F.col(c) for c in keep or []]).schema
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    hits = "__n_words long, __spans array<struct<start:int,end:int>>, __items array<string>"
    own = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "__id long", "__text string"]
    none = [F.lit(None).cast("long").alias("__n_words"), F.array().cast("array<struct<start:int,end:int>>").alias("__spans"), F.array().cast("array<string>").alias("__items")]
    src = docs.select(*[F.col(c) for c in keep or []], F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"), *none)
    found_schema = pa.schema([("__n_words", pa.int64()), ("__spans", pa.list_(span)), ("__items", pa.list_(pa.string()))])

    def searched(df: DataFrame, holders: list) -> DataFrame:
        run_id = uuid.uuid4().hex

        def scan(texts, spans_before, items_before):
            words = [words_of(t) for t in texts]
            got = [([(x["start"], x["end"]) for x in spans], set(items)) for spans, items in zip(spans_before, items_before)]
            for k, holder in enumerate(holders):
                for search in tables_of((run_id, k, window), holder, window):
                    for ws, (spans, found) in zip(words, got):
                        search.find(ws, spans, found)
            for ws, (spans, found) in zip(words, got):
                yield len(ws), [{"start": a, "end": b} for a, b in merged(spans)], sorted(found)

        def run(batches):
            for b in batches:
                for first, n in slices(b.column("__text"), slice_bytes):
                    part = b.slice(first, n)
                    rows = scan(raw_strings(part.column("__text")), part.column("__spans").to_pylist(), part.column("__items").to_pylist())
                    yield pa.RecordBatch.from_arrays([*part.columns[:len(own)], *to_batch(list(rows), found_schema).columns], names=[*kept.names, "__id", "__text", *found_schema.names])

        return with_python(df).mapInArrow(run, ", ".join([*own, hits]))

    sc = docs.sparkSession.sparkContext
    waiting: list = []
    for block in item_blocks(benchmark, block_bytes):
        if len(waiting) == blocks:  # another block follows: search these, write, and forget them
            src = stage(searched(src, waiting), "leaks")
            for holder in waiting:
                holder.destroy()
            waiting = []
        waiting.append(sc.broadcast(block))
    res = searched(src, waiting)
    words = F.aggregate("__spans", F.lit(0), lambda total, x: total + x["end"] - x["start"]).cast("long")
    out = {"doc_id": F.col("__id"), "n_words": F.col("__n_words"), "n_hit": words, "spans": F.col("__spans"), "items": F.col("__items")}
    return res.select(*[F.col(c) for c in keep or []], *[c.alias(n) for n, c in out.items() if not (keep and n in keep)])


def slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """(first, rows) of consecutive slices of at most ``limit`` bytes; a longer text is a slice of its own."""
    first = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if i > first and size + (n or 0) > limit:
            yield first, i - first
            first, size = i, 0
        size += n or 0
    if first < len(texts):
        yield first, len(texts) - first


def leak_report(found: DataFrame) -> DataFrame:
    """The digest columns: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
