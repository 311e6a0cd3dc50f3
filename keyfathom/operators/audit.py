"""Audit of dead keys: does raw source still hold the msgid, or all static parts of it?"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfathom.functions.strings import skeleton_fragments
from keyfathom.operators.liveness import KEY

#: Characters of patterns in one automaton; more patterns are searched in blocks.
BLOCK = 4_000_000


def patterns(dead: DataFrame, min_len: int) -> DataFrame:
    """(key, role, pattern): the whole msgid, and its distinct fragments. Plural and context play no part."""
    keys = dead.select(*KEY).where(F.col("msgid") != "")
    role = lambda name, text: F.struct(F.lit(name).alias("role"), text.alias("pattern"))
    parts = F.transform(F.array_distinct(skeleton_fragments(F.col("msgid"), min_len)), lambda x: role("fragment", x))
    rows = keys.select(*KEY, F.explode(F.concat(F.array(role("whole", F.col("msgid"))), parts)).alias("r"))
    return rows.select(*KEY, "r.role", "r.pattern")


def found_patterns(content: DataFrame, wanted: DataFrame, limit: int = BLOCK) -> DataFrame:
    """Distinct ``pattern`` values that occur anywhere in ``content``, overlapping ones too; the empty one occurs always.

    Each block of patterns is one automaton and one pass; a task reports a pattern once. The patterns of one block go to
    the executors as a broadcast of at most ``limit`` characters (or one pattern); of several blocks each is searched
    for, and its patterns released, before the next one is read."""
    spark = content.sparkSession
    distinct = wanted.select("pattern").distinct()
    total = distinct.agg(F.sum(F.char_length("pattern"))).first()[0] or 0
    blocks = max(1, -(-total // limit))
    if blocks > 1:
        distinct = distinct.persist()

    def search(held: Broadcast) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = ahocorasick.Automaton()
            for w in held.value:
                if w:
                    tree.add_word(w, w)
            seen = {w for w in held.value if not w}
            if len(tree):
                tree.make_automaton()
                for batch in batches:
                    for text in batch.column(0).to_pylist():
                        if text:
                            seen.update(w for _, w in tree.iter(text))
            yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], names=["pattern"])

        return content.select("content").mapInArrow(run, "pattern string").distinct()

    found: list[DataFrame] = []
    for k in range(blocks):
        own = distinct if blocks == 1 else distinct.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k)
        held = spark.sparkContext.broadcast([r[0] for r in own.toLocalIterator()])
        part = search(held)
        if blocks > 1:
            # in the folder that the cluster shares, where there is one
            part = part.checkpoint() if spark.sparkContext.getCheckpointDir() else part.persist()
            part.count()
            held.unpersist()
        found.append(part)
    if blocks > 1:
        distinct.unpersist()
    return reduce(DataFrame.union, found)


def contained_patterns(content: DataFrame, wanted: DataFrame) -> DataFrame:
    """The same by a theta join, for small pattern sets."""
    distinct = wanted.select("pattern").distinct()
    return distinct.join(content.select("content"), F.col("content").contains(F.col("pattern")), "left_semi")


def tiers(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """(key, trace): substring if the whole msgid occurs, skeleton if it has fragments and all occur in some file or
    other, else none."""
    hit = wanted.join(found.select("pattern", F.lit(True).alias("hit")), "pattern", "left")
    whole, part = F.col("role") == "whole", F.col("role") == "fragment"
    seen = F.coalesce(F.col("hit"), F.lit(False))
    keys = hit.groupBy(*KEY).agg(F.bool_or(whole & seen).alias("whole"), F.count_if(part).alias("parts"), F.count_if(part & seen).alias("seen"))
    trace = F.when(F.col("whole"), "substring").when((F.col("parts") > 0) & (F.col("parts") == F.col("seen")), "skeleton").otherwise("none")
    return keys.select(*KEY, trace.alias("trace"))


def audit(dead: DataFrame, content: DataFrame, min_len: int) -> DataFrame:
    """Trace of each dead key in ``content`` (column content, nulls skipped)."""
    wanted = patterns(dead, min_len)
    return tiers(wanted, found_patterns(content, wanted))
