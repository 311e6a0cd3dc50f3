"""The queries of this subpackage: thin wrappers that apply an operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfathom.llm import decontaminate, language, media, ngram_join, oracle, quality, sharding, suffix_dedup, toxicity, unigram, url_templates
from keyfathom.llm.samples import fold
from keyfathom.llm.storage import bounded_batches

#: A SentencePiece model file.
PIECES = os.environ.get("KEYFATHOM_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
#: Whether its scores are merge ranks, as a byte-pair model's are.
RANKS = os.environ.get("KEYFATHOM_PIECE_RANKS", "1") == "1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item in them. Null, empty and blank texts and items give no rows; repeated rows as many."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for each page. A null url, or one without ``://``, has empty host and path and no rule."""
    return url_templates.judge(table(spark, sf_dir, "pages"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document. A null text and one without letters are ``und`` with score 0; a null id is not held out."""
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs))
    return found.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether decoding gives its text. Null and empty texts have none."""
    return unigram.encode_documents(table(spark, sf_dir, "documents"), unigram.load(PIECES, RANKS))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each document. A null text counts as empty, which scores as a text without words."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shard and slot for each document, by bytes. A null text counts as empty; equal texts share a shard."""
    return sharding.shard(table(spark, sf_dir, "documents"), 40)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored form, features and NPY tile of each document. Null and empty texts store a row of zeros."""
    return media.text_media(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated strings and passages take of each document. A null text counts as empty; short ones lose nothing."""
    return suffix_dedup.repeat_report(table(spark, sf_dir, "documents"), least=suffix_dedup.WORDS)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and class of each document. Without words a document has none and is alone; repeated rows are one set."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash", "first")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each document. A null text counts as empty, which has all statistics zero."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_url_templates": op2_url_templates,
    "op3_language": op3_language,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_toxicity": op5_toxicity,
    "op6_sharding": op6_sharding,
    "op7_media": op7_media,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_ngram_join": op9_ngram_join,
    "op10_quality": op10_quality,
}

ORACLE_SQL: dict[str, str] = {"op8_suffix_dedup": oracle.REPEATS, "op9_ngram_join": oracle.NEAR}
