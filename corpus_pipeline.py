"""The corpus pipeline: five stages over ``documents``, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfathom.llm import decontaminate, language, ngram_join, suffix_dedup, unigram
from keyfathom.llm.queries import PIECES, RANKS, table
from keyfathom.llm.storage import bounded_batches, drop, materialize, small


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without known languages: no letter, or under half of the letters in words of such languages.

    A null or empty text has no letter and goes; repeated rows go or stay alike."""
    bounded_batches(spark)
    return language.keep_identified(docs, language.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep, of each group of near duplicates, the document with the smallest id, and one of repeated rows.

    Of different texts with that id, or where the whole group has none, the one with the smallest hash stays."""
    bounded_batches(spark)
    near = materialize(ngram_join.near_duplicates(docs), "near")
    key = ["doc_id", "text_hash"]
    dropped = near.where(~F.col("first")).select(*key).distinct()
    repeated = near.groupBy(*key).count().where("count > 1").select(*key)
    same = lambda keys: docs["doc_id"].eqNullSafe(keys["doc_id"]) & F.xxhash64(docs["text"]).eqNullSafe(keys["text_hash"])
    dropped, repeated = materialize(dropped, "dropped"), materialize(repeated, "repeated")
    drop(near)
    dropped = small(dropped)
    kept = docs.join(dropped, same(dropped), "left_anti")
    if repeated.isEmpty():
        return kept
    repeated = small(repeated)
    return kept.join(repeated, same(repeated), "left_anti").union(kept.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", "text"]))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut strings of 400 bytes and passages of over 50 words that repeat out of the texts; n_chars is counted anew.

    All rows stay: a null text as it is, a text that is cut away as a whole as an empty one. Repeated rows lose all they share."""
    bounded_batches(spark)
    return suffix_dedup.remove_repeats(docs, least=suffix_dedup.WORDS).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item. Null and empty texts hold none and stay."""
    bounded_batches(spark)
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether decoding them gives the text. Null and empty texts have none."""
    bounded_batches(spark)
    return unigram.encode_documents(docs, unigram.load(PIECES, RANKS))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_leaks),
    ("sentencepiece", tokenize),
]

#: SQL can't express these stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
