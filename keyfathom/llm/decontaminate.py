"""Benchmark decontamination: documents that hold a benchmark item with at most a sixteenth of its characters edited.

Q-gram lemma: if e edits turn an item of m characters into a stretch of a document, they share at least
m - Q + 1 - Q e character q-grams, at diagonals (document position less item position) that differ by e at most. Shared
q-grams are counted in overlapping bands of 2 (e + 1) diagonals; bands that reach the bound are verified by a banded
alignment. Items of fewer than Q characters are searched for exact copies. Case is ignored. The benchmark is taken in blocks, so what workers hold is bounded."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfathom.llm.storage import materialize
from keyfathom.llm.textbytes import mix
from keyfathom.llm.workers import tidy

Q = 10
EDIT_SHARE = 16
BLOCK_CHARACTERS = 2_000_000
BITS = 22
#: Characters of documents that are searched at once.
STRETCH = 1 << 20
#: Shared q-grams that are counted at once.
HITS = 1 << 20


def codes(text: str) -> np.ndarray:
    """Lower-cased code points, one for each character of the text."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)


def characters(c: np.ndarray) -> str:
    """The string of some code points."""
    return c.tobytes().decode("utf-32-le", "surrogatepass")


def grams(c: np.ndarray) -> np.ndarray:
    """64-bit hashes of all q-grams."""
    if len(c) < Q:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(c) - Q + 1, np.uint64)
    for j in range(Q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[j : len(c) - Q + 1 + j]
    return mix(h)


def budget(m: int) -> int:
    """Edits allowed for an item of m >= Q characters; no more than leave a shared q-gram."""
    return min(m // EDIT_SHARE, (m - Q) // Q)


@dataclass
class Index:
    ids: list[int]  # of the items, then of the short ones
    items: list[np.ndarray]
    short: list[str]  # items of fewer than Q characters
    gram: np.ndarray  # distinct, sorted
    first: np.ndarray  # where the postings of each begin (len + 1)
    item: np.ndarray
    place: np.ndarray
    filter: np.ndarray
    edits: np.ndarray
    bound: np.ndarray

    @cached_property
    def exact(self) -> ahocorasick.Automaton:
        """Finds the short items; a worker makes it when it first needs it."""
        tree = ahocorasick.Automaton()
        for k, text in enumerate(self.short):
            tree.add_word(text, (*tree.get(text, ()), len(self.items) + k))
        tree.make_automaton()
        return tree


def build(rows: Iterable[tuple[int, str | None]]) -> Index:
    """Index of (item_id, text); null, empty and blank texts can't be found and are left out."""
    ids, items, short_ids, short = [], [], [], []
    for i, text in rows:
        c = codes(text or "")
        if len(c) >= Q:
            ids.append(i)
            items.append(c)
        elif text and text.strip():
            short_ids.append(i)
            short.append(characters(c))
    hashes = [grams(c) for c in items]
    every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
    place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
    order = np.argsort(every, kind="stable")
    gram, first = np.unique(every[order], return_index=True)
    bloom = np.zeros(1 << BITS, bool)
    bloom[(gram >> np.uint64(64 - BITS)).astype(np.int64)] = True
    m = np.array([len(c) for c in items], np.int64)
    edits = np.array([budget(x) for x in m.tolist()], np.int64)
    return Index(ids + short_ids, items, short, gram, np.append(first, len(every)), item[order], place[order], bloom, edits, m - Q + 1 - Q * edits)


def align(pattern: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """Fewest edits between the pattern and a stretch of the text at diagonals low to high, and that stretch's end.

    Row i holds, for each diagonal k, the cost of the pattern's first i characters against a stretch that ends at text
    position i + k and begins anywhere in the band."""
    n, width = len(pattern), high - low + 1
    far = n + len(text) + 1
    at = np.arange(low, high + 1)
    row = np.where((at >= 0) & (at <= len(text)), 0, far)
    padded = np.concatenate((np.full(max(0, -low) + 1, -1), text.astype(np.int64), np.full(n + max(0, high) + 1, -1)))
    shift = max(0, -low) + 1
    steps = np.arange(width)
    for i in range(1, n + 1):
        ends = at + i
        seen = padded[np.clip(ends - 1 + shift, 0, len(padded) - 1)]
        best = row + (seen != pattern[i - 1])
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)
        best = np.minimum.accumulate(best - steps) + steps
        row = np.where((ends >= 0) & (ends <= len(text)), best, far)
    k = int(row.argmin())
    return int(row[k]), int(at[k] + n)


def search(index: Index, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of every item found, the best place for each item and text."""
    at = 0
    while at < len(texts):
        first, size, parts = at, 0, []
        while at < len(texts) and (size < STRETCH or not parts):
            parts.append(codes(texts[at] or ""))
            size += len(parts[-1])
            at += 1
        yield from _search(index, first, parts)
        if index.short:
            yield from _search_exact(index, first, parts)


def _search_exact(index: Index, number: int, parts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
    for t, part in enumerate(parts):
        ends: dict[int, int] = {}
        for last, items in index.exact.iter(characters(part)):
            for i in items:
                ends.setdefault(i, last + 1)
        for i, end in sorted(ends.items()):
            yield number + t, i, end - len(index.short[i - len(index.items)]), end, 0


def _bands(index: Index, found: np.ndarray, text: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, item, band) of the bands that reach their item's bound, by text, from q-grams (index of the gram, text,
    place) in order. Hits are counted HITS at a time; what is carried on is the counts of one text."""
    n = index.first[found + 1] - index.first[found]
    total = np.cumsum(n)
    key, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = 0
    while at < len(found):
        last = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + HITS, side="right")))
        m = n[at:last]
        posting = np.repeat(index.first[found[at:last]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        item, own = index.item[posting], np.repeat(text[at:last], m).astype(np.int64)
        band = (np.repeat(place[at:last], m) - index.place[posting]) // (index.edits[item] + 1) + (1 << 30)
        pair = own * len(index.items) + item
        # a hit counts for the bands [band, band + 2) and [band - 1, band + 1) of ``step`` diagonals
        new, times = np.unique(np.concatenate((pair, pair)) << 32 | np.concatenate((band, band - 1)), return_counts=True)
        key, where = np.unique(np.concatenate((key, new)), return_inverse=True)
        count = np.bincount(where, np.concatenate((count, times)), minlength=len(key)).astype(np.int64)
        pair = key >> 32
        ended = pair // len(index.items) < (text[last] if last < len(text) else np.iinfo(np.int64).max)
        good = ended & (count >= index.bound[pair % len(index.items)])
        yield pair[good] // len(index.items), pair[good] % len(index.items), (key[good] & 0xFFFFFFFF) - (1 << 30)
        key, count = key[~ended], count[~ended]
        at = last


def _search(index: Index, number: int, parts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
    lengths = np.array([len(p) for p in parts])
    starts = np.cumsum(lengths) - lengths
    flat = np.concatenate(parts)
    h = grams(flat)
    spots = np.flatnonzero(index.filter[(h >> np.uint64(64 - BITS)).astype(np.int64)]) if len(index.gram) else np.zeros(0, np.int64)
    if not len(spots):
        return
    found = np.searchsorted(index.gram, h[spots])
    found[found == len(index.gram)] = 0
    doc = np.searchsorted(starts, spots, side="right") - 1
    good = (index.gram[found] == h[spots]) & (spots + Q <= (starts + lengths)[doc])
    spots, found, doc = spots[good], found[good], doc[good]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for text, item, bands in _bands(index, found, doc, spots - starts[doc]):
        # from the first band on, so that of equal places the first is found first
        for t, i, band in zip(text.tolist(), item.tolist(), bands.tolist(), strict=True):
            e = int(index.edits[i])
            if best.get((t, i), (e + 1,))[0] == 0:
                continue
            low = band * (e + 1)
            cost, end = align(index.items[i], parts[t], low, low + 2 * (e + 1) - 1)
            if cost <= e and (cost, end) < best.get((t, i), (e + 1, 0, 0))[:2]:
                own = parts[t][max(0, end - len(index.items[i]) - e) : end]
                _, back = align(index.items[i][::-1], own[::-1], -e, e)
                best[t, i] = (cost, end, end - back)
    for (t, i), (cost, end, start) in sorted(best.items()):
        yield number + t, i, start, end, cost


def blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text", limit: int = BLOCK_CHARACTERS) -> Iterator[Index]:
    """Indexes of about ``limit`` characters that together hold all items. A lone item above it is a block of its own."""
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("i"), F.col(text).alias("t"))
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-total // limit))
    for k in range(n):
        own = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield build(sorted(((r.i, r.t) for r in own.toLocalIterator()), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


def _with_last(found: Iterator[Index]) -> Iterator[tuple[Index, bool]]:
    now = next(found)
    for after in found:
        yield now, False
        now = after
    yield now, True


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, start, end (characters of the text), edits.

    Only documents with a leak have rows, repeated rows as often as they occur. Of several places the one with fewest
    edits, then the first, is given. Null and empty texts and empty tables give no rows; other columns are ignored."""
    source = docs.select(F.col(key).cast("long").alias(key), F.col(text))

    def one(index: Index) -> DataFrame:
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(search(held.value, batch.column(1).to_pylist()))
                columns = [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([held.value.ids[r[1]] for r in rows], pa.int64())]
                columns += [pa.array([r[j] for r in rows], pa.int32()) for j in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "item_id", "start", "end", "edits"])

        return source.mapInArrow(tidy(run), f"{key} long, item_id long, start int, end int, edits int")

    # of several blocks each is searched for before the next one is made, so that one index at a time is held
    parts: list[DataFrame] = []
    for index, last in _with_last(blocks(benchmark)):
        parts.append(one(index) if last and not parts else materialize(one(index), "leaks"))
    return reduce(DataFrame.union, parts)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found; null and empty texts stay."""
    place = docs.columns.index(text)
    for index, last in _with_last(blocks(benchmark)):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                keep = np.ones(len(batch), bool)
                for t, *_ in search(held.value, batch.column(place).to_pylist()):
                    keep[t] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(tidy(run), docs.schema)
        if not last:
            docs = materialize(docs, "clean")
    return docs
