"""Collocation mining by top-order marginalisation.

Every word position opens one window of ``order`` words, padded where its piece ends. Only these longest
windows are counted; the lead columns are shifts of one array of word numbers. A window's count then
gives every shorter phrase's: ``ROLLUP`` over the words sums it to the prefixes of ``order - 1`` words and
so on down to single words and the number of all words of a language. Each phrase occurrence starts at
exactly one position, so the sums are exact.

Windows are dealt to tasks by their first word, so a task knows the exact count of every window and prefix that it
holds. What is below ``min_count`` there is merged under the longest prefix that is not: only its sum is of use,
and the rollup's own shuffle stays small. First words and word pairs that a sample shows to be very common are
salted over many tasks (a pair by its third word); a salted prefix is never merged, so the counts stay exact
whatever the sample holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.common import raw_strings, stage, with_python

ORDER = 3
#: Bytes of text whose windows are counted in memory at once, and whose windows one task merges.
CHUNK_BYTES, TASK_BYTES = 5 << 20, 24 << 20
#: Windows that a merging task holds at once (more only for one first word).
MERGE_ROWS = 1 << 18
_SEPARATOR = re.compile(rb"[.,;:!?\x0A-\x0D]")
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\v\f\r"]] = 2
#: Salts of very common first words, and of the first of the two rankings.
_SALTS = 256
#: Text from which very common prefixes are found (they only decide how windows are dealt), and their least share.
SAMPLE_BYTES, COMMON = 8 << 20, 1 / 1024


def slices(text: bytes, size: int = CHUNK_BYTES) -> Iterator[bytes]:
    """A text in slices of about ``size`` bytes, each cut behind a separator, so no piece is cut."""
    at = 0
    while len(text) - at > size:
        found = _SEPARATOR.search(text, at + size)
        if found is None:
            break
        yield text[at:found.end()]
        at = found.end()
    yield text[at:]


def windows(text: bytes, order: int = ORDER) -> tuple[pa.Array, np.ndarray]:
    """(words of a distinct window joined by a space, its count), sorted; a padded window has fewer words."""
    raw = np.frombuffer(text.lower(), dtype=np.uint8)  # bytes: only A-Z are lowered
    kind = _KIND[raw]
    word = kind == 0
    edge = np.diff(np.concatenate([[False], word, [False]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw[word])).dictionary_encode()
    by_name = pc.sort_indices(coded.dictionary).to_numpy()
    names = coded.dictionary.take(pa.array(by_name))
    number = np.empty(len(names), dtype=np.int64)
    number[by_name] = np.arange(1, len(names) + 1)  # 0 is the padding
    first = number[coded.indices.to_numpy()]
    base = len(names) + 1
    leads = [first]
    for k in range(1, order):
        lead = np.zeros_like(first)
        lead[:-k] = np.where(piece[k:] == piece[:-k], first[k:], 0)
        leads.append(lead)
    key, parts = leads[0], [leads[0]]
    if base ** order < 1 << 62:
        for lead in leads[1:]:
            key = key * base + lead
        keys, n = _counted(key)
        rest, parts = keys, []
        for _ in range(order):
            parts.insert(0, rest % base)
            rest = rest // base
    else:  # too many different words for one integer: number the prefixes first
        chain = []
        for lead in leads[1:]:
            seen, key = np.unique(key, return_inverse=True)
            chain.append(seen)
            key = key * base + lead
        keys, n = _counted(key)
        parts, rest = [], keys
        for seen in reversed(chain):
            parts.insert(0, rest % base)
            rest = seen[rest // base]
        parts.insert(0, rest)
    columns = [names.take(pa.array(p - 1, mask=p == 0)) for p in parts]
    return pc.binary_join_element_wise(*columns, " ", null_handling="skip"), n


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.sort(key)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[at], np.diff(np.append(at, len(key))).astype(np.int64)


def count_windows(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n) of the distinct longest windows. docs: (lang, text) without NULLs."""

    def counted(lang, held):
        gram, n = windows(b"\n".join(held), order)  # a separator: no window spans two texts
        for at in range(0, len(n), 1 << 16):
            part = gram[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), part, pa.array(n[at:at + (1 << 16)])], ["lang", "gram", "n"])

    def run(batches):
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), raw_strings(b.column(1))):
                for part in slices(text):
                    held.setdefault(lang, []).append(part)
                    size[lang] = size.get(lang, 0) + len(part) + 1
                    if size[lang] >= CHUNK_BYTES:
                        yield from counted(lang, held.pop(lang))
                        size.pop(lang)
                if sum(size.values()) >= 2 * CHUNK_BYTES:  # many languages
                    for k in list(held):
                        yield from counted(k, held.pop(k))
                    size.clear()
        for lang, parts in held.items():
            yield from counted(lang, parts)

    return with_python(docs.select("lang", "text")).mapInArrow(run, "lang string, gram string, n long")


def _first(n: int):
    return F.substring_index("gram", " ", n)


def common_prefixes(docs: DataFrame, text_bytes: int) -> tuple[list[str], list[str]]:
    """Very common (first words, pairs) of a sample, each as lang, line break, words; at most 1 / COMMON of either."""
    share = min(1.0, SAMPLE_BYTES / max(text_bytes, 1))
    seen = count_windows(docs.sample(share, seed=7) if share < 1 else docs)
    by = lambda n: F.concat_ws("\n", "lang", _first(n))
    total = seen.groupBy(by(1).alias("word"), by(2).alias("pair")).agg(F.count("*").alias("n"))
    total = stage(total, "common")
    least = (total.agg(F.sum("n")).first()[0] or 0) * COMMON
    keep = lambda c: [r[0] for r in total.groupBy(c).agg(F.sum("n").alias("n")).where(F.col("n") >= max(least, 1000)).select(c).collect()]
    return keep("word"), keep("pair")


def merge_windows(counts: DataFrame, min_count: int, tasks: int, words: list[str], pairs: list[str], order: int = ORDER) -> DataFrame:
    """(lang, w1, ..., n): every window with n >= ``min_count``, and what is left under its longest prefix that is
    counted so often (NULL behind it, as behind a padded window: neither is a longer phrase)."""
    kind = F.when(F.concat_ws("\n", "lang", _first(2)).isin(pairs), 2).when(F.concat_ws("\n", "lang", _first(1)).isin(words), 1).otherwise(0)
    dealt = counts.withColumn("kind", kind.cast("int"))
    salt = F.when(F.col("kind") == 2, F.pmod(F.xxhash64("gram"), F.lit(_SALTS))).when(F.col("kind") == 1, F.pmod(F.xxhash64(_first(2)), F.lit(_SALTS))).otherwise(0)
    dealt = dealt.repartition(tasks, F.col("lang"), _first(1), salt)
    # rows of one first word (and salt) stand together, so a task holds few at a time
    dealt = dealt.withColumn("group", F.xxhash64(F.col("lang"), _first(1), salt)).sortWithinPartitions("group")
    names = [f"w{i}" for i in range(1, order + 1)]

    def summed(held):
        t = pa.Table.from_batches(held).group_by(["group", "lang", "gram", "kind"]).aggregate([("n", "sum")])
        return t.select(["lang", "gram", "n_sum", "kind", "group"]).rename_columns(["lang", "gram", "n", "kind", "group"]).combine_chunks()

    def run(batches):
        held, rows, most = [], 0, MERGE_ROWS
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= most:
                last = held[-1].column(4)[-1]
                other = [pc.not_equal(x.column(4), last) for x in held]
                whole = [x.filter(m) for x, m in zip(held, other)]
                held = summed([x.filter(pc.invert(m)) for x, m in zip(held, other)]).to_batches()
                rows = sum(x.num_rows for x in held)
                most = rows + MERGE_ROWS
                if sum(x.num_rows for x in whole):
                    yield from _merged(summed(whole), min_count, order, names)
        if rows:
            yield from _merged(summed(held), min_count, order, names)

    return dealt.mapInArrow(run, ", ".join(["lang string", *(f"{c} string" for c in names), "n long"]))


def _merged(t: pa.Table, min_count: int, order: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """One task's windows, see merge_windows(). A prefix's count is whole in its task unless its word (kind 1) or pair
    (kind 2) is salted; those are kept."""
    flat = pc.list_slice(pc.split_pattern(t["gram"].combine_chunks(), " "), 0, order, return_fixed_size_list=True).flatten()
    rows = np.arange(len(t))
    columns = [flat.take(pa.array(rows * order + k)) for k in range(order)]
    n, kind = t["n"].to_numpy(), t["kind"].to_numpy()
    code = t["lang"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    keep = np.zeros(len(t), dtype=np.int64)
    for size, column in enumerate(columns, 1):
        coded = column.dictionary_encode()
        there = ~column.is_null().to_numpy(zero_copy_only=False)
        code = code * (len(coded.dictionary) + 1) + pc.fill_null(coded.indices, -1).to_numpy() + 1
        _, code = np.unique(code, return_inverse=True)
        enough = np.bincount(code, n)[code] >= min_count
        if size < order:
            enough |= kind >= (1 if size == 1 else 2)
        keep[there & enough & (keep == size - 1)] = size
    masked = [pc.if_else(pa.array(keep >= size), c, pa.scalar(None, pa.string())) for size, c in enumerate(columns, 1)]
    out = pa.table([t["lang"], *masked, t["n"]], names=["lang", *names, "n"]).group_by(["lang", *names]).aggregate([("n", "sum")])
    out = out.select(["lang", *names, "n_sum"]).rename_columns(["lang", *names, "n"])
    yield from out.combine_chunks().to_batches(max_chunksize=1 << 16)


def marginals(merged: DataFrame, min_count: int, order: int = ORDER) -> DataFrame:
    """(lang, phrase, size, f) of every phrase of 1 to ``order`` words with f >= ``min_count``, and of size 0
    (phrase empty) the number of all words of each language. merged: merge_windows()."""
    cols = [f"w{i}" for i in range(1, order + 1)]
    rolled = merged.sparkSession.sql(f"""SELECT lang, {', '.join(cols)}, CAST(grouping_id() AS INT) AS gone, sum(n) AS f
                                         FROM {{merged}} GROUP BY lang, ROLLUP({', '.join(cols)})""", merged=merged)
    # NULL in a word that is not rolled up is padding, so no phrase; Catalyst moves this filter on grouping columns below the sum
    real = F.col("gone") == (1 << order) - 1
    for size in range(1, order + 1):
        real = real | ((F.col("gone") == (1 << order - size) - 1) & F.col(cols[size - 1]).isNotNull())
    size = F.lit(order) - F.bit_count("gone")
    return rolled.where(real).where((F.col("gone") == (1 << order) - 1) | (F.col("f") >= min_count)).select("lang", F.concat_ws(" ", *cols).alias("phrase"), size.cast("int").alias("size"), "f")


def collocations(docs: DataFrame, min_count: int = 10, top_k: int = 2000, inside_percent: int = 50, order: int = ORDER,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The first ``top_k`` phrases of 2 to ``order`` words of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lowered; pieces end at ``.,;:!?`` and line breaks, words at space and tab. score is
    floor(10^6 a^2 / (l r)) of the phrase's lowest cut (ties: the shorter first part), in exact decimals
    (counts up to 10^15). A phrase inside a longer candidate that has at least ``inside_percent`` % of its
    count is dropped. Order: score, then a, descending, then the phrase's bytes.

    A NULL lang is ``und``; NULL and empty texts have no words; repeated rows count each time; a language
    without a candidate, and an empty table, gives no rows. Other columns are not read.
    """
    base = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spark = docs.sparkSession
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(1, -(-size // TASK_BYTES), min(-(-size // (1 << 20)), spark.sparkContext.defaultParallelism))
    merged = stage(merge_windows(count_windows(base, order), min_count, tasks, *common_prefixes(base, size), order), "windows")
    return ranked(stage(marginals(merged, min_count, order), "grams"), top_k, inside_percent)


def ranked(grams: DataFrame, top_k: int, inside_percent: int) -> DataFrame:
    """collocations() from the counts of marginals()."""
    whole = grams.where("size = 0").select("lang", F.col("f").alias("n"))
    counts = grams.where("size > 0").select("lang", "phrase", "f")
    found = grams.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    words = F.split("phrase", " ")
    join_words = lambda first, n: F.array_join(F.slice(words, first, n), " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), join_words(F.lit(1), k).alias("first"), join_words(k + 1, F.col("size") - k).alias("rest")))
    cut = found.select("lang", "phrase", "a", F.inline(cuts))
    cut = cut.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    wide = lambda c: f"CAST({c} AS DECIMAL(15, 0))"
    score = F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * ({wide('a')} * {wide('a')})) DIV ({wide('l')} * {wide('r')})")
    scored = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    scored = scored.select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    # every shorter phrase inside a candidate, with the largest count that any such candidate has
    spots = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: join_words(i, k))))
    inner = found.where("size > 2").select("lang", F.explode(spots).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = scored.join(inner, ["lang", "phrase"], "left").where(f"longer IS NULL OR NOT (100 * longer >= {int(inside_percent)} * a)")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(_SALTS))  # no task ranks all phrases of a language
    near = left.withColumn("near", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*best))).where(F.col("near") <= top_k)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top_k)
    return ranked.join(whole, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
