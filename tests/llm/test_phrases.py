"""Collocations against plain counting in Python."""

import random
import re
from collections import Counter

import pytest

from riskspark.llm import phrases

SCHEMA = "doc_id long, lang string, text string, phrase string, n long"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(rows, min_count, top_k=2000, order=3):
    f, total = Counter(), Counter()
    for _, lang, text, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, order + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i:i + m])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    out = {}
    for (lang, g), a in found.items():
        if any(100 * b >= 50 * a and l2 == lang and len(x) > len(g) and any(x[i:i + len(g)] == g for i in range(len(x) - len(g) + 1)) for (l2, x), b in found.items()):
            continue
        score, k = min((10**6 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
        out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), a, f[lang, g[:k]], f[lang, g[k:]]))
    rows = set()
    for lang, v in out.items():
        for rank, (score, _, phrase, a, l, r) in enumerate(sorted(v)[:top_k], 1):
            rows.add((lang, rank, phrase.decode(), a, l, r, total[lang], -score))
    return rows


def run(spark, rows, min_count, **kw):
    out = phrases.collocations(spark.createDataFrame(rows, SCHEMA), min_count, **kw)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got))
    return set(got)


def texts(seed, n=80, size=60):
    rng = random.Random(seed)
    words = ["The", "the", "of", "Éa", "x\x01", "a|b", "nl", "zz", "q'", " k", "aa", "bb"]
    seps = [" "] * 12 + ["\t", "  ", ". ", ",", "\n", "!", "\x0b"]
    return [(i, rng.choice(["en", "fr", None, "und"]), "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(0, size))), "x", 1) for i in range(n)]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_counts_scores_and_drops(spark, order):
    rows = texts(order)
    assert run(spark, rows, 3, order=order) == brute(rows, 3, order=order)


def test_small_chunks_salted_prefixes_and_top_k(spark, monkeypatch):
    """Cut chunks, merging tasks that hold a row at a time, and every prefix salted: the counts stay the same."""
    rows = texts(9, n=150, size=90)
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 700)
    monkeypatch.setattr(phrases, "TASK_BYTES", 5000)
    monkeypatch.setattr(phrases, "MERGE_ROWS", 1)
    want = brute(rows, 4, 7)
    assert run(spark, rows, 4, top_k=7) == want
    every = lambda size: sorted({"\n".join((lang or "und", " ".join(w[i:i + size]))) for _, lang, t, *_ in rows for p in re.split(r"[.,;:!?\x0A-\x0D]", lower(t)) for w in [re.findall(r"[^\x20\x09]+", p)] for i in range(len(w))})
    monkeypatch.setattr(phrases, "common_prefixes", lambda docs, size: (every(1), every(2)[::2]))
    assert run(spark, rows, 4, top_k=7) == want


def test_edges(spark):
    long = "lorem ipsum " * 30000 + "end"
    rows = [(1, "en", None, "", 0), (2, "en", "", "", 0), (None, None, long, "", 0), (3, "en", "A b. a B", "", 0), (3, "en", "A b. a B", "", 0), (4, "en", "ha ha ha ha", "", 0), (5, "", "a b", "", 0)]
    assert run(spark, rows, 2) == brute(rows, 2)
    assert run(spark, [], 2) == set() and run(spark, [(1, "en", None, "", 0)], 2) == set()


def test_slices_cut_behind_separators():
    text = b"ab cd, ef gh. ij kl mn op"
    for size in (1, 4, 7, 100):
        parts = list(phrases.slices(text, size))
        assert b"".join(parts) == text and all(p[-1:] in b".," for p in parts[:-1])


def test_products_beyond_64_bits(spark):
    """Counts of a corpus of 10^15 words: the score is exact."""
    a, l, r = 123456789012345, 223456789012345, 323456789012347
    grams = [("en", "", 0, 10**15), ("en", "x", 1, l), ("en", "y", 1, r), ("en", "x y", 2, a)]
    table = spark.createDataFrame(grams, "lang string, phrase string, size int, f long")
    assert [tuple(x) for x in phrases.ranked(table, 2000, 50).collect()] == [("en", 1, "x y", a, l, r, 10**15, 10**6 * a * a // (l * r))]
