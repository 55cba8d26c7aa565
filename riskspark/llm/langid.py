"""Language identification by prediction by partial matching (PPM) over bytes.

For every language a context tree of order 0 to 3 is counted on a bounded sample of labelled texts.
The code length of a byte after a context is exact PPM (escape method C with full exclusion): a byte
not seen after the longest known context pays the escape there and is coded in the next shorter one,
where the bytes already excluded share nothing; below order 0 all bytes left are equally likely. The
statistics are frozen, so the code length depends only on (context, byte) and is tabulated once; a
text's score is the sum over all its bytes under each language's tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.common import chunked, raw_strings, stage, with_python

ORDER = 3
#: Most bytes of labelled text per language from which the trees are counted (documented bound).
TRAIN_BYTES = 2_000_000
#: Texts are drawn in pieces of at most this many bytes.
PIECE_BYTES = 1 << 14
UNKNOWN = "und"
_PAD = b"\n" * ORDER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _ints(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context of three bytes as an integer, byte) of every position from the fourth on."""
    b = buf.astype(np.int32)
    return (b[:-3] << 16) | (b[1:-2] << 8) | b[2:-1], buf[3:]


def _bytes_of(text: bytes) -> np.ndarray:
    return _LOWER[np.frombuffer(_PAD + text, dtype=np.uint8)]


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over whole texts: gram is context * 256 + byte. docs: (lang, text)."""

    def run(batches):
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()
            for lang in sorted(set(langs)):
                grams: list[np.ndarray] = []
                for code, text in zip(langs, texts):
                    if code == lang and text:
                        context, byte = _ints(_bytes_of(text))
                        grams.append(np.unique(context.astype(np.int64) << 8 | byte, return_counts=True))
                if grams:
                    keys, where = np.unique(np.concatenate([g for g, _ in grams]), return_inverse=True)
                    n = np.bincount(where, np.concatenate([c for _, c in grams])).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["lang", "gram", "n"])

    return with_python(docs.select("lang", "text")).mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _ppm_bits(levels: list[np.ndarray]) -> np.ndarray:
    """Code lengths in bits, (rows, 256). levels: counts (rows, 256) from the longest context to the
    empty one; a context never seen has only zeros and is passed without an escape."""
    rows = levels[0].shape[0]
    bits = np.zeros((rows, 256))
    paid = np.zeros((rows, 1))
    coded = np.zeros((rows, 256), dtype=bool)
    for counts in levels:
        left = np.where(coded, 0.0, counts)
        seen = left > 0
        total, kinds = left.sum(1, keepdims=True), seen.sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            bits = np.where(seen, paid - np.log2(left / (total + kinds)), bits)
            escape = np.where(kinds > 0, -np.log2(kinds / (total + kinds)), 0.0)
        coded |= seen
        # nothing is left to escape to when every byte is coded
        paid = paid + np.where(coded.all(1, keepdims=True), 0.0, escape)
    rest = 256 - coded.sum(1, keepdims=True)
    with np.errstate(divide="ignore"):
        return np.where(coded, bits, paid + np.log2(np.maximum(rest, 1)))


class Model:
    """Frozen statistics: ``langs``, the known contexts (of 3, 2, 1, 0 bytes) and their code lengths."""

    def __init__(self, grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(grams)
        trees = [self._tree(*grams[k]) for k in self.langs]
        #: contexts known to any language, as (bytes, integer), shortest first; the empty one is state 0
        self.contexts = [(size, c) for size in range(ORDER + 1) for c in sorted({c for t in trees for c in t[size]})] or [(0, 0)]
        self.bits = np.zeros((len(self.contexts), 256, len(self.langs)), dtype=np.float32)
        zero = np.zeros(256)
        for i, tree in enumerate(trees):
            for s in range(0, len(self.contexts), 2048):
                part = self.contexts[s:s + 2048]
                levels = [np.stack([tree[k].get(c & ((1 << 8 * k) - 1), zero) if k <= size else zero for size, c in part]) for k in range(ORDER, -1, -1)]
                self.bits[s:s + 2048, :, i] = _ppm_bits(levels)

    @staticmethod
    def _tree(grams: np.ndarray, n: np.ndarray) -> list[dict[int, np.ndarray]]:
        """Per context length: context -> counts of the 256 bytes."""
        out: list[dict[int, np.ndarray]] = []
        for size in range(ORDER + 1):
            tree: dict[int, np.ndarray] = {}
            keys, where = np.unique((grams >> 8) & ((1 << 8 * size) - 1), return_inverse=True)
            flat = np.bincount(where * 256 + (grams & 255), n, minlength=len(keys) * 256).reshape(-1, 256)
            for k, row in zip(keys.tolist(), flat):
                tree[k] = row
            out.append(tree)
        return out

    def states(self) -> np.ndarray:
        """State of every integer of three bytes: its longest known context."""
        table = np.zeros(1 << 24, dtype=np.int32)
        for state, (size, c) in enumerate(self.contexts):  # shortest first, longer ones overwrite
            table[c::1 << 8 * size] = state
        return table


def score_texts(texts: list[bytes], bits: np.ndarray, states: np.ndarray, chunk: int = 1 << 20) -> np.ndarray:
    """(texts, languages) code lengths in bits of whole texts; long ones are read chunk by chunk."""
    flat = bits.reshape(-1, bits.shape[2])
    out = np.zeros((len(texts), bits.shape[2]))
    group: list[tuple[int, np.ndarray]] = []

    def flush():
        buf = np.concatenate([b for _, b in group])
        context, byte = _ints(buf)
        cost = flat[states[context].astype(np.int64) << 8 | byte]
        at, cuts = 0, []
        for _, b in group:  # the first three bytes of each piece are context only
            cuts += [at, at + len(b) - 3]
            at += len(b)
        cuts[-1] = len(cost)
        sums = np.add.reduceat(np.concatenate([cost, np.zeros((1, cost.shape[1]), cost.dtype)]), cuts, axis=0, dtype=np.float64)
        for k, (i, _) in enumerate(group):
            out[i] += sums[2 * k]
        group.clear()

    size = 0
    for i, text in enumerate(texts):
        if not text:
            continue
        buf = _bytes_of(text)
        for s in range(0, len(buf) - 3, chunk):
            piece = buf[s:s + chunk + 3]
            group.append((i, piece))
            size += len(piece)
            if size >= chunk:
                flush()
                size = 0
    if group:
        flush()
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def with_letter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a letter."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([bool(t) and has_letter(t) for t in b.column(at).to_pylist()], pa.bool_()))

    return with_python(docs).mapInArrow(run, docs.schema)


def _pieces(key: str, text: bytes) -> Iterator[tuple[int, bytes]]:
    """(hash of key, place and piece, piece) of every piece of a text."""
    for at in range(0, len(text), PIECE_BYTES):
        piece = text[at:at + PIECE_BYTES]
        yield xxhash.xxh3_64_intdigest(piece, seed=xxhash.xxh3_64_intdigest(f"{at} {key}")) - (1 << 63), piece


def draw(labelled: DataFrame, train_bytes: int) -> DataFrame:
    """(lang, text binary): of every language its pieces in hash order until ``train_bytes`` are reached, the last one
    cut there, so each language has at least one and none has more bytes. labelled: (key, lang, text)."""
    labelled = with_python(labelled.select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")))
    sizes = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("size", pa.int64())])
    drawn = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("text", pa.binary())])

    def measure(batches):
        for b in batches:
            for key, lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw_strings(b.column(2))):
                for h, piece in _pieces(key, text):
                    yield lang, h, len(piece)

    pieces = stage(labelled.mapInArrow(lambda bs: chunked(measure(bs), sizes, max_rows=1 << 15), "lang string, h long, size long").distinct(), "pieces")
    # a language's pieces are never sorted as a whole: first ranges of hashes, then the pieces in the ranges needed
    before = lambda by: F.coalesce(F.sum("size").over(Window.partitionBy("lang").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = pieces.groupBy("lang", F.shiftright("h", 48).alias("range")).agg(F.sum("size").alias("size")).withColumn("before", before("range"))
    needed = ranges.where(F.col("before") < train_bytes).groupBy("lang").agg(F.max("range").alias("last"))
    near = pieces.join(F.broadcast(needed), "lang").where(F.shiftright("h", 48) <= F.col("last")).withColumn("before", before("h")).where(F.col("before") < train_bytes)
    ends = near.groupBy("lang").agg(F.max(F.struct("h", F.least("size", F.lit(train_bytes) - F.col("before")).alias("size"))).alias("end"))
    last = {r["lang"]: (r["end"]["h"], r["end"]["size"]) for r in ends.collect()}  # a row for each language

    def take(batches):
        for b in batches:
            for key, lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw_strings(b.column(2))):
                end, size = last[lang]
                for h, piece in _pieces(key, text):
                    if h <= end:
                        yield lang, h, piece if h < end else piece[:size]

    sample = labelled.mapInArrow(lambda bs: chunked(take(bs), drawn, weigh=lambda r: len(r[2])), "lang string, h long, text binary")
    return sample.dropDuplicates(["lang", "h"]).select("lang", "text")


def fit(train: DataFrame, train_bytes: int = TRAIN_BYTES) -> Model:
    """Count the trees. train: (key, lang, text) rows that may be learned from.

    Of every language pieces of its texts are counted, drawn in hash order up to ``train_bytes`` (all of
    them where they are fewer). Rows without lang or text teach nothing; rows equal in all three teach once.
    """
    sample = draw(train.where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''"), train_bytes)
    grams: dict[str, tuple[list[int], list[int]]] = {}
    for r in count_grams(sample).collect():  # bounded by train_bytes for each language
        keys, n = grams.setdefault(r["lang"], ([], []))
        keys.append(r["gram"])
        n.append(r["n"])
    return Model({k: (np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)) for k, (a, b) in grams.items()})


_STATES: dict[str, np.ndarray] = {}


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, bits_per_byte. With ``keep``, these columns
    of ``docs`` come first instead of doc_id.

    score is the posterior of the best language under equal priors, from the exact code lengths. A
    NULL text, a text without a letter, or a model without languages: ``und``, score 0. Ties go to
    the first language in alphabetical order. Only the text is read for a prediction.
    """
    sc = docs.sparkSession.sparkContext
    token = f"{sc.applicationId}-{id(model)}"
    held = sc.broadcast((model.langs, model.contexts, model.bits))
    kept = docs.select(*(keep or [])).schema
    n = len(kept)

    def run(batches):
        langs, contexts, bits = held.value
        if token not in _STATES:
            _STATES.clear()
            shell = Model.__new__(Model)
            shell.contexts = contexts
            _STATES[token] = Model.states(shell)
        for b in batches:
            texts = b.column(n + 1).to_pylist()
            known = [bool(t) and bool(langs) and has_letter(t) for t in texts]
            raw = [t.encode() if ok else b"" for t, ok in zip(texts, known)]
            cost = score_texts(raw, bits, _STATES[token]) if langs else np.zeros((len(texts), 1))
            best = cost.argmin(1)
            low = cost[np.arange(len(texts)), best]
            post = 1.0 / np.exp2(np.maximum(low[:, None] - cost, -1000.0)).sum(1)
            size = np.array([max(1, len(r)) for r in raw])
            yield pa.RecordBatch.from_arrays([
                *b.columns[:n + 1], pa.array([langs[k] if ok else UNKNOWN for k, ok in zip(best, known)], pa.string()),
                pa.array(np.where(known, post, 0.0)), pa.array(np.where(known, low / size, 0.0))], names=names)

    inner = [f"k{i}" for i in range(n)]
    names = [*inner, "doc_id", "lang_pred", "score", "bits_per_byte"]
    src = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep or [], inner)], F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    types = ", ".join([*(f"{k} {f.dataType.simpleString()}" for k, f in zip(inner, kept)), "doc_id long, lang_pred string, score double, bits_per_byte double"])
    out = with_python(src).mapInArrow(run, types)
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, inner)], "lang_pred", "score", "bits_per_byte") if keep else out


def fold(doc_id="doc_id"):
    """crc32 of doc_id as text, modulo 4."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def identify(docs: DataFrame, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """Learn from the folds other than 2 with a lang, predict every row of ``docs`` (doc_id, text, lang).

    Returns doc_id, held_out, lang_pred, score, bits_per_byte. A NULL doc_id is in no fold: it is not
    learned from and held_out is false. Repeated rows are each predicted. Empty tables: no rows.
    """
    train = docs.where(fold() != 2).select(F.col("doc_id").alias("key"), "lang", "text")
    out = predict(docs, fit(train, train_bytes))
    return out.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")
