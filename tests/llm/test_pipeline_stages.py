"""The corpus pipeline against brute force: every stage on its own input, and the whole."""

import zlib
from collections import Counter

import pytest

import corpus_pipeline as pipe
from .test_ops import SF, check_packing, roots, slow_dedup, slow_fingerprint, slow_leaks

from riskspark.llm import substring
from riskspark.llm.common import stage

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, function in pipe.STAGES:
        before, docs = docs, stage(function(spark, docs, SF), name)
        out.append((before, docs))
    return out


def rows(df):
    return df.select("doc_id", "text").collect()


def test_stages_return_the_columns_of_documents(outputs):
    assert [n for n, _ in pipe.STAGES] == ["language", "near_duplicates", "repeated_passages", "decontamination", "packing"]
    assert all(a.columns == b.columns for a, b in outputs[:-1])


def test_language_stage_keeps_every_document_with_a_letter(outputs):
    before, after = map(rows, outputs[0])
    assert {r.doc_id for r in after} == {r.doc_id for r in before if any(map(str.isalpha, r.text or ""))}


def test_language_stage_without_any_label_drops_only_what_has_no_letter(spark):
    held = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 4 == 2)  # its lang may not be learned from
    docs = spark.createDataFrame([(1, "some text", None, "s", 9), (2, "été", None, "s", 3), (3, "12 - 34", None, "s", 7), (4, None, None, "s", None), (5, "", None, "s", 0),
                                  (None, "字", None, "s", 1), (held, "held out", "en", "s", 8)], SCHEMA)
    got = pipe.keep_language(spark, docs, SF)
    assert got.columns == docs.columns
    assert {(r.doc_id, r.text, r.lang) for r in got.collect()} == {(1, "some text", None), (2, "été", None), (None, "字", None), (held, "held out", "en")}


def test_near_duplicate_stage_keeps_the_smallest_of_each_component(outputs):
    before, after = map(rows, outputs[1])
    fps = {r.doc_id: slow_fingerprint(r.text) for r in before}
    ids = sorted(fps)
    root = roots(ids, [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (fps[a] ^ fps[b]).bit_count() <= 3])
    assert Counter(r.doc_id for r in after) == Counter(set(root.values()))


def test_passage_stage_cuts_later_occurrences(outputs):
    before, after = map(rows, outputs[2])
    want = slow_dedup({(r.doc_id, r.text) for r in before}, substring.MIN_WORDS)
    assert {(r.doc_id, r.text) for r in after} == {(d, x[0]) for (d, _), x in want.items()}
    assert all(r.n_chars == len(r.text) for r in outputs[2][1].collect())


def test_decontamination_stage_drops_documents_with_benchmark_windows(spark, outputs):
    before, after = map(rows, outputs[3])
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if not slow_leaks(r.text, items)[1]}


def test_packing_stage_packs_what_is_left(outputs):
    before, after = outputs[4]
    check_packing(after.collect(), {r.doc_id: r.text for r in rows(before)}, 2048)


def test_near_duplicate_stage_with_missing_and_shared_ids(spark):
    """Clean documents stay whatever their ids; of a group one stays, with the smallest id."""
    a, b, c, d = ("one text about rivers and boats", "another text about hills and snow", "a third text about bread and butter", "a fourth text about trains and rails")
    docs = [(None, a, "en", "s", 1), (None, b, "en", "s", 2), (None, b, "en", "t", 2), (5, c, "en", "s", 3), (None, c, "en", "s", 3),
            (7, d, "en", "s", 4), (7, a + " " + d, "en", "s", 5), (9, d, "de", "s", 4), (7, d, "en", "s", 4)]
    got = pipe.drop_near_duplicates(spark, spark.createDataFrame(docs, SCHEMA), SF).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(None, a), (None, b), (5, c), (7, d), (7, a + " " + d)])


def test_edges(spark):
    docs = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "12 --", "en", "s", 5), (4, "some words of a text", "en", "s", 20), (4, "some words of a text", "en", "s", 20), (5, "Some Words of a text", None, "s", 20),
            (7, "x" * 50_000, "en", "s", 50_000), (None, "no id but text", "en", "s", 14)]
    df = spark.createDataFrame(docs, SCHEMA)
    for _, function in pipe.STAGES[:-1]:
        df = stage(function(spark, df, SF), "edge")
    assert Counter(r.doc_id for r in df.collect()) == Counter([4, 7, None])
    assert pipe.pack_documents(spark, df, SF).select("doc_id").distinct().count() == 3
    df = spark.createDataFrame([], SCHEMA)
    for _, function in pipe.STAGES:
        df = stage(function(spark, df, SF), "empty")
    assert df.count() == 0
