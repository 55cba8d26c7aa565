"""From raw documents to packed training sequences: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskspark.llm import decontam, langid, packing, simhash, substring
from riskspark.llm.common import stage, table


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without an identifiable language (no text, or no letter); ``lang`` becomes the
    prediction where it was NULL. Where no document outside fold 2 has a lang there is nothing to learn
    from: the same documents are dropped, and a NULL ``lang`` stays NULL."""
    model = langid.fit(docs.where(langid.fold() != 2).select(F.col("doc_id").alias("key"), "lang", "text"))
    if not model.langs:
        return langid.with_letter(docs)
    found = langid.predict(docs, model, keep=docs.columns).where(F.col("lang_pred") != langid.UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash component: the one with the smallest doc_id (a NULL one ranks last, and among
    equal ones a hash of the row decides). Different texts stay even where they share a doc_id or have none."""
    key = [F.xxhash64(F.lit(k), *[F.col(f"`{c}`") for c in docs.columns]) for k in (1, 2)]  # rows equal in every column are one
    marked = docs.select("*", key[0].alias("__row_hi"), key[1].alias("__row_lo"))
    found = simhash.near_duplicates(marked, keep=["__row_hi", "__row_lo"])
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__row_hi", "__row_lo")).alias("best")
    winners = found.groupBy("root").agg(best).select("best.__row_hi", "best.__row_lo")
    kept = marked.join(winners, ["__row_hi", "__row_lo"], "left_semi")
    one = Window.partitionBy("__row_hi", "__row_lo").orderBy("__row_hi")
    return kept.withColumn("__row_of_key", F.row_number().over(one)).where("__row_of_key = 1").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document holds; documents stay, ``n_chars`` follows the text.

    NULL and empty texts stay as they are (a NULL text has a NULL ``n_chars``); a text of repeats only becomes empty. Ties go to
    the smaller doc_id, then the earlier place; a NULL doc_id ranks first. Rows equal in doc_id and text get the same text.
    An empty table gives no rows."""
    return substring.dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item.

    A NULL or empty text holds none, so it stays; repeated rows stay or go together. Items without text are never found, repeated
    items count once. An empty benchmark drops nothing; an empty table gives no rows."""
    found = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark", "item_id", "text"), keep=docs.columns)
    return found.where("n_hit = 0").select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in training sequences.

    A NULL or empty text is its end id alone. Every row is packed, repeated ones too; equal Hilbert keys are ordered by document. An
    empty table gives no rows."""
    return packing.pack(docs)


STAGES = [("language", keep_language), ("near_duplicates", drop_near_duplicates), ("repeated_passages", drop_repeated_passages), ("decontamination", drop_contaminated), ("packing", pack_documents)]

#: Fingerprints, code lengths and tokens have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
