"""Bounded, deterministic samples of labelled rows for fitting models on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def by_hash(df: DataFrame, wanted: int, key: str) -> DataFrame:
    """Rows whose hashed id falls into one of the residue classes that hold about ``wanted`` rows; all if there are fewer."""
    step = max(1, df.count() // wanted)
    return df.where(F.pmod(F.xxhash64(F.col(key)), F.lit(step)) == 0) if step > 1 else df


def within(df: DataFrame, most: int, key: str, text: str) -> DataFrame:
    """The rows of a sample whose texts together have at most ``most`` bytes: ids are taken in the order of their hash,
    each with all its rows, and one whose texts would go beyond is passed over. Its ids and sizes reach the driver."""
    sizes = df.groupBy(F.col(key).cast("long").alias("k")).agg(F.sum(F.octet_length(text)).alias("size")).select("k", "size", F.xxhash64("k").alias("h")).collect()
    left, chosen = most, []
    for row in sorted(sizes, key=lambda r: (r.h, r.k is None, r.k)):
        if (row.size or 0) <= left:
            left -= row.size or 0
            chosen.append((row.k,))
    if len(chosen) == len(sizes):
        return df
    keys = df.sparkSession.createDataFrame(chosen, "k long")
    return df.join(F.broadcast(keys), df[key].cast("long").eqNullSafe(keys["k"]), "left_semi")


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, wanted: int, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, label) of about ``wanted`` labelled documents outside fold ``held`` with at most ``most`` bytes of
    texts. An id with several labels has their largest."""
    rows = labels.where(F.col(label).isNotNull() & (fold(key, folds) != held)).groupBy(key).agg(F.max(label).cast("int").alias("label"))
    some = by_hash(rows, wanted, key)  # at most about twice ``wanted`` rows of two numbers
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("text"))
    return within(texts.join(F.broadcast(some), key), most, key, "text")
