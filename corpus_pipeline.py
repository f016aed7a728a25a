"""The corpus pipeline: language, near duplicates, repeated passages, leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a frame that the caller
writes as Parquet and reads again as the next stage's docs.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe, decontaminate, jaccard_join, langid, substring_dedup
from weftgraph.llm.common import dropped, if_small, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose best language is less likely than this is rejected.
LEAST_LANGUAGE_SCORE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language the network can tell: null, empty and letterless
    texts go; null and repeated ids are as other rows; further columns are left out; an empty
    table stays empty."""
    found = langid.identify(docs.select(*COLUMNS), langid.fit(docs))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the least by doc_id, then by the text's hash.

    Rows are judged one by one, so different texts under one doc_id are kept or not by their
    own groups; of rows equal in doc_id and text the least stays; rows without a doc_id, and
    texts without words, are groups of their own; an empty table stays empty."""
    docs = docs.select(*COLUMNS)
    joined = jaccard_join.join(docs)
    found = stored(joined, "classes-of")
    dropped(*joined.reads)
    text_key = F.xxhash64(F.coalesce("text", F.lit("")))
    out = stored(found.where("doc_id <> class_id or th <> class_th").select("doc_id", "th").distinct(), "copies")
    kept = docs.withColumn("th", text_key).join(if_small(out), ["doc_id", "th"], "left_anti")
    twice = stored(found.where("doc_id is not null").groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "th"), "repeats")
    if twice.isEmpty():
        return kept.select(*COLUMNS)
    twice = if_small(twice)
    one = kept.join(twice, ["doc_id", "th"], "left_semi").groupBy("doc_id", "th").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return kept.join(twice, ["doc_id", "th"], "left_anti").select(*COLUMNS).unionByName(one)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated windows; a text that loses nothing stays as it is, and a
    document that loses every word goes.  Null and empty texts, null and repeated ids stay;
    an empty table stays empty."""
    found = substring_dedup.dedup(docs.select(*COLUMNS))
    changed = F.col("n_removed") > 0
    return found.where(~changed | (F.col("n_removed") < F.col("n_words"))).select(
        "doc_id", F.when(changed, F.col("kept_text")).otherwise(F.col("text")).alias("text"), "lang", "source",
        F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no benchmark item of five words or more, as fewer words are no sign of a
    leak; null and repeated ids are told apart by their texts, null and empty texts contain
    nothing, and an empty table stays empty."""
    row = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text"))
    found = decontaminate.contained(docs.select(row.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    out = stored(found.select(F.col("doc_id").alias("__row")).distinct(), "leaks")
    return docs.select(*COLUMNS).withColumn("__row", row).join(if_small(out), "__row", "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of what they are and decode to; null and
    empty texts have no tokens, repeated rows repeat, an empty table stays empty."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    found = bpe.encode(docs.select(*COLUMNS), vocabulary, ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))
    return found.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("leaks", leaks),
    ("tokens", tokens),
]

#: A trained network decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
