"""Facts of a growing source corpus: the batch extraction over a stream of files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from keyfathom.config import CallSpec
from keyfathom.operators.extract import extract_facts


def file_facts(spark: SparkSession, path: str, specs: Sequence[CallSpec], min_len: int) -> DataFrame:
    """A stream of facts from a folder to which Parquet files of (path, lang, content) are added.

    Extraction keeps no state, so the sink may append; ``liveness.classify`` reads what the sink has written."""
    return extract_facts(spark.readStream.schema("path string, lang string, content string").parquet(path), specs, min_len)
