"""Rows of one key from a stream of Arrow batches that are sorted by the key, and connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfathom.llm.storage import BROADCAST_KEYS, drop, materialize, rows_of, stands_for
from keyfathom.llm.workers import tidy


def key_runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of consecutive rows whose first ``keys`` columns (64-bit integers without nulls) are equal."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(int(c[a]) for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of a whole graph to (node, root)."""
    own = [np.stack([c.to_numpy() for c in batch.columns]) for batch in batches if len(batch)]
    if not own:
        return
    nodes, where = np.unique(np.concatenate(own, axis=1), return_inverse=True)
    a, b = where.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        least = root.copy()
        np.minimum.at(least, root[a], root[b])
        np.minimum.at(least, root[b], root[a])
        least = least[root]
        least = least[least]
        if (least == root).all():
            break
        root = least
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); root is the least node of its component.

    Few edges (at most BROADCAST_KEYS, which is counted) are joined in one task. More are in alternating large-star and
    small-star rounds; each round's edges are written to the shared folder, and only a count and a sum of their hashes
    reach the driver. What a node's edges are joined with, one row a node, is written before the join, so that Spark can
    split the edges of a hub."""
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if rows_of(edges) <= BROADCAST_KEYS:
        roots = materialize(edges.coalesce(1).mapInArrow(tidy(_joined), "node long, root long"), "roots")
        drop(edges)
        return roots
    sign = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
    now = sign(edges)
    while True:
        both = edges.union(edges.select("b", "a"))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        down = materialize(large.select(F.col("b").alias("node"), F.col("a").alias("low")), "down")
        low = materialize(down.groupBy("node").agg(F.min("low").alias("m")), "low")
        star = down.join(low, "node").select(F.col("m").alias("a"), F.explode(F.array("node", "low")).alias("b")).where("a <> b").distinct()
        after = materialize(star, "edges")
        drop(least, low, down, edges)
        edges, before, now = after, now, sign(after)
        if now == before:
            roots = edges.select("a").distinct()
            return stands_for(edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(roots.select("a", "a")), edges)
