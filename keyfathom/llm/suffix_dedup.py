"""Suffix-array dedup: remove every byte covered by a string of 400 bytes that also starts elsewhere.

Column-wise multi-document construction. Any string of LENGTH bytes has a least hash among its KEEP-byte grams; where
a gram is least in some such string, the text has an anchor. Equal strings have equal anchors at equal offsets, so the
only texts to compare are the pieces around equal anchors: LENGTH bytes from the anchor on and LENGTH - KEEP before it.
Pieces that occur twice (by 128 bits of hash within an anchor) repeat as a whole. The distinct pieces of an anchor are aligned on it and form a collection:
each round inserts one symbol of every piece, from the last column to the first. The symbols before the sorted
suffixes are that column's Burrows-Wheeler transform; a stable sort by them gives the next order, and the common
prefixes of neighbours follow from the least common prefix between their places before. Since equal strings of a
collection lie in the same columns, a column's suffixes need no comparison with another's, and a round costs time in
proportion to the number of pieces. Columns are read from one sequential file, orders and common prefixes are appended
to another, and a last pass over that file marks the starts whose neighbours share LENGTH symbols.

An anchor with more than CROWD distinct pieces is a hot key, and is split by content, not by chance: the strings that
begin in the nearer half of its columns need equal bytes to the right, those in the farther half equal bytes to the left.
So each piece, cut to what either half can see, goes to two smaller collections, named by those bytes; pieces that have
become equal repeat as a whole. What is still too large is halved again, until a collection is one column, where no two
pieces are left that could be equal. No collection of more than CROWD pieces is ever compared, and none is skipped."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyfathom.llm.runs import key_runs
from keyfathom.llm.storage import BROADCAST_KEYS, drop, materialize, rows_of, small
from keyfathom.llm.textbytes import BASE, MASK, as_long, mix, pieces, utf8, words
from keyfathom.llm.workers import tidy

LENGTH = 400
KEEP = 256
#: Passages of so many words repeat whatever their bytes; each word is CODE bytes of its hash in the search for them.
WORDS = 51
CODE = 4
CROWD = 16_000
BATCH = 8192
END = 256
#: Places of one piece in a text that are merged by numpy.
MANY = 32
#: Bytes of one text that are hashed at once.
STRETCH = 1 << 21
SPANS = "array<struct<start:int,end:int>>"


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over each window of ``width`` values, by doubling."""
    done = 1
    while done * 2 <= width:
        x = pick(x[: len(x) - done], x[done:])
        done *= 2
    rest = width - done
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def _grams(data: np.ndarray, keep: int) -> np.ndarray:
    """Hashes of all strings of ``keep`` (a power of two) bytes."""
    h = data.astype(np.uint64) + np.uint64(1)
    step, factor = 1, BASE
    while step < keep:
        h = h[: len(h) - step] * np.uint64(factor) + h[step:]
        step, factor = step * 2, factor * factor & MASK
    return mix(h)


def anchors(data: np.ndarray, length: int = LENGTH, keep: int = KEEP) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that are least in some string of ``length`` bytes; equal least ones all count."""
    n, width = len(data), length - keep + 1
    places, values = [], []
    for at in range(0, n - length + 1, STRETCH):
        h = _grams(data[max(0, at - length) : min(n, at + STRETCH + 2 * length)], keep)
        least = _sliding(h, width, np.minimum)
        edge = np.zeros(width - 1, np.uint64)
        found = np.flatnonzero(_sliding(np.concatenate((edge, least, edge)), width, np.maximum) == h)
        values.append(h[found])
        places.append(found + max(0, at - length))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    where, what = np.concatenate(places), np.concatenate(values)
    where, first = np.unique(where, return_index=True)
    return where, what[first]


ID = ["anchor", "piece", "proof"]
_ID = "anchor long, piece long, proof long"


def _occurrences(docs: DataFrame, length: int, keep: int) -> DataFrame:
    """(anchor, piece, proof, doc_id, home, places): a row for each distinct piece of a document. ``piece`` and ``proof``
    are the two halves of a hash."""
    before = length - keep

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            row: list[int] = []
            keys: list[tuple[int, bytes]] = []
            places: list[list[int]] = []
            for i in range(len(batch)):
                text = data[offsets[i] : offsets[i + 1]]
                if len(text) < length:
                    continue
                where, what = anchors(text, length, keep)
                raw = text.tobytes()
                own: dict[tuple[int, bytes], list[int]] = {}
                for p, h in zip(where.tolist(), as_long(what).tolist(), strict=True):
                    left = min(p, before)
                    own.setdefault((h, xxhash.xxh3_128_digest(raw[p - left : p + length], left)), []).append(p)
                row += [i] * len(own)
                keys += own
                places += own.values()
            take = pa.array(row, pa.int64())
            names = np.frombuffer(b"".join([k[1] for k in keys]), np.int64).reshape(-1, 2)
            columns = [pa.array([k[0] for k in keys], pa.int64()), pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy())]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(0).take(take), batch.column(1).take(take), pa.array(places, pa.list_(pa.int32()))], names=[*ID, "doc_id", "home", "places"])

    return docs.select("doc_id", "home", "text").mapInArrow(tidy(run), _ID + ", doc_id long, home long, places array<int>")


def _cut_pieces(rows: DataFrame, length: int, keep: int) -> DataFrame:
    """(anchor, piece, proof, left, body) from rows (text, wanted array of (anchor, piece, proof, place))."""
    before = length - keep

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, wanted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                raw = text.as_py()
                for w in wanted:
                    left = min(w["place"], before)
                    out.append((w["anchor"], w["piece"], w["proof"], left, raw[w["place"] - left : w["place"] + length]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=[*ID, "left", "body"])

    return rows.mapInArrow(tidy(run), _ID + ", left int, body binary")


class _LeastBetween:
    """Range minima of a sequence by a sparse table."""

    def __init__(self, x: np.ndarray) -> None:
        self.levels = [x]
        while 2 << (len(self.levels) - 1) <= len(x):
            half = 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(self.levels[-1][:-half], self.levels[-1][half:]))
        self.log = np.zeros(len(x) + 1, np.int8)
        for k in range(1, len(self.levels)):
            self.log[1 << k :] = k

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minima over [first, last], both inside."""
        out = np.empty(len(first), self.levels[0].dtype)
        depth = self.log[last - first + 1]
        for k in np.unique(depth).tolist():
            at = depth == k
            out[at] = np.minimum(self.levels[k][first[at]], self.levels[k][last[at] - (1 << k) + 1])
        return out


def repeated_starts(groups: np.ndarray, lefts: np.ndarray, bodies: list[bytes], length: int = LENGTH, keep: int = KEEP) -> np.ndarray:
    """For pieces sorted by group, whether the string of ``length`` bytes from each column on occurs in another piece.

    Returns bool (pieces, length - keep + 1); column length - keep is the anchor. At most 65,536 groups."""
    m, before = len(bodies), length - keep
    width = before + length
    flags = np.zeros((m, before + 1), bool)
    with tempfile.TemporaryFile() as columns, tempfile.TemporaryFile() as state:
        table = np.full((m, width), END, np.uint16)
        for i, body in enumerate(bodies):
            table[i, before - lefts[i] : before - lefts[i] + len(body)] = np.frombuffer(body, np.uint8)
        for c in range(width - 1, -1, -1):
            columns.write(table[:, c].tobytes())
        del table
        columns.seek(0)
        group = np.unique(groups, return_inverse=True)[1].astype(np.uint16)
        order = np.argsort(group, kind="stable")
        common = np.zeros(m, np.int16)
        for c in range(width - 1, -1, -1):
            symbols = np.frombuffer(columns.read(2 * m), np.uint16)
            transform = symbols[order]  # the symbols before the sorted suffixes
            moved = np.argsort(transform, kind="stable")
            moved = moved[np.argsort(group[order[moved]], kind="stable")]
            least = _LeastBetween(common)
            a, b = moved[:-1], moved[1:]
            order = order[moved]
            same = (transform[a] == transform[b]) & (transform[b] != END) & (group[order[:-1]] == group[order[1:]])
            common = np.zeros(m, np.int16)
            spots = np.flatnonzero(same)
            common[spots + 1] = np.minimum(least(a[spots] + 1, b[spots]) + 1, length)
            if c <= before:
                state.write(order.astype(np.int32).tobytes())
                state.write(common.tobytes())
        state.seek(0)
        for c in range(before, -1, -1):
            order = np.frombuffer(state.read(4 * m), np.int32)
            deep = np.append(np.frombuffer(state.read(2 * m), np.int16) >= length, False)
            flags[order, c] = deep[:-1] | deep[1:]
    return flags


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """[first, last + 1) of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _compare(length: int, keep: int):  # noqa: ANN202
    """Rows (cell, anchor, piece, proof, left, body), sorted by cell, to the spans that repeat within their cell."""
    before = length - keep
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def done(tables: list[pa.Table]) -> pa.RecordBatch:
        held = pa.concat_tables(tables)
        flags = repeated_starts(held.column("cell").to_numpy(), held.column("left").to_numpy(), held.column("body").to_pylist(), length, keep)
        some = np.flatnonzero(flags.any(axis=1))
        found = [[{"start": a - before, "end": b - 1 - before + length} for a, b in runs_of(flags[i])] for i in some]
        held = held.take(pa.array(some)).combine_chunks()
        one = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        return pa.RecordBatch.from_arrays([*(one(held.column(c)) for c in ID), pa.array(found, spans)], names=[*ID, "spans"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: list[pa.Table] = []
        size = 0
        for group in key_runs(batches, 1):
            if size and size + len(group) > BATCH:
                yield done(tables)
                tables, size = [], 0
            tables.append(group)
            size += len(group)
        if tables:
            yield done(tables)

    return run


def _span(start: Column, end: Column) -> Column:
    return F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))).cast(SPANS)


def _halves(part: DataFrame, length: int, keep: int) -> tuple[DataFrame, DataFrame]:
    """(next part, marks) of a part (cell, low, high, anchor, piece, proof, left, body) of hot cells.

    A part's row holds the strings that begin ``low`` to ``high`` bytes before the anchor. Each half of that range goes
    to the cell that the bytes which all of its strings cover name; rows that can't hold such a string go. Of rows that
    are equal in their cell all are marked, and one stands for them from then on."""
    before = length - keep
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    half = lambda a, b: F.struct(a.cast("int").alias("low"), b.cast("int").alias("high"))
    two = part.select("cell", *ID, "left", "body", F.explode(F.array(half(F.col("low"), middle), half(middle + 1, F.col("high")))).alias("h"))
    two = two.select("cell", *ID, "left", "body", "h.low", "h.high").where("low <= high")
    two = two.where((F.col("left") >= F.col("low")) & (F.octet_length("body") >= F.col("left") + length - F.col("high")))
    kept = F.least("left", "high")
    common = F.substring("body", F.col("left") - F.col("low") + 1, F.col("low") + length - F.col("high"))
    seen = F.substring("body", F.col("left") - kept + 1, kept + length - F.col("low"))
    two = two.select(F.xxhash64("cell", "low", "high", common).alias("cell"), "low", "high", *ID, kept.alias("left"), seen.alias("body"))
    two = two.withColumns({"x": F.xxhash64("left", "body"), "y": F.xxhash64(F.lit(before), "left", "body")})
    two = materialize(two, "halves")
    sums = two.groupBy("cell", "x", "y").agg(F.count("*").alias("n"), F.min(F.struct(*ID)).alias("one"))
    sums = materialize(sums, "sums")
    alive = materialize(sums.groupBy("cell").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("cell"), "alive")
    own = two.join(small(sums), ["cell", "x", "y"])
    # whatever of a row equals another row repeats at all columns where the text goes on for long enough
    whole = own.where("n > 1").select(*ID, _span(-F.col("left"), length - F.col("low")).alias("spans"))
    after = own.where((F.struct(*ID) == F.col("one")) & (F.col("low") < F.col("high"))).join(small(alive), "cell", "left_semi")
    after = materialize(after.select("cell", "low", "high", *ID, "left", "body"), "part")
    whole = materialize(whole, "whole")
    drop(two, sums, alive)
    return after, whole


def find_repeats(docs: DataFrame, length: int = LENGTH, keep: int = KEEP, crowd: int = CROWD) -> DataFrame:
    """(doc_id, home, marks) of the documents that hold repeated strings; marks are (places, spans), byte ranges relative
    to the places.

    ``docs`` has doc_id, text and home = xxhash64(text)."""
    before = length - keep
    occurrences = materialize(_occurrences(docs, length, keep), "occurrences")
    twice = materialize(occurrences.groupBy("anchor").agg(F.sum(F.size("places")).alias("n")).where("n > 1").select("anchor"), "twice")
    again = materialize(occurrences.join(small(twice), "anchor", "left_semi"), "again")
    drop(occurrences, twice)
    first = F.struct("home", "doc_id", F.element_at("places", 1).alias("place"))
    distinct = materialize(again.groupBy(*ID).agg(F.sum(F.size("places")).alias("n"), F.min(first).alias("at")), "distinct")
    mixed = distinct.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("anchor")
    mixed = materialize(mixed, "mixed")
    fetch = distinct.join(small(mixed), "anchor", "left_semi").select(*ID, "at.*")
    wanted = fetch.groupBy("home", "doc_id").agg(F.collect_list(F.struct(*ID, "place")).alias("wanted"))
    wanted = materialize(wanted, "wanted")
    texts = docs
    if rows_of(wanted) <= BROADCAST_KEYS:
        texts = docs.join(F.broadcast(wanted.select("home").distinct()), "home", "left_semi")
    picked = texts.join(wanted, (texts["home"] == wanted["home"]) & texts["doc_id"].eqNullSafe(wanted["doc_id"]))
    picked = picked.select(F.col("text").cast("binary").alias("text"), "wanted")
    # a row that occurs twice gives its pieces twice; those have n > 1 and are marked as wholes
    part = _cut_pieces(picked, length, keep)
    part = materialize(part.select(F.col("anchor").alias("cell"), F.lit(0).alias("low"), F.lit(before).alias("high"), *ID, "left", "body"), "pieces")
    marks = [distinct.where("n > 1").select(*ID, _span(F.lit(-before), F.lit(length)).alias("spans"))]
    parts = [mixed, wanted, part]
    compare = _compare(length, keep)
    while True:
        hot = materialize(part.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("cell"), "hot")
        cool = part.join(small(hot), "cell", "left_anti") if rows_of(hot) else part
        cool = cool.select("cell", *ID, "left", "body").repartition("cell").sortWithinPartitions("cell")
        marks.append(cool.mapInArrow(tidy(compare), _ID + f", spans {SPANS}"))
        parts.append(hot)
        if not rows_of(hot):
            break
        part, whole = _halves(part.join(small(hot), "cell", "left_semi"), length, keep)
        marks.append(whole)
        parts += [part, whole]
    marked = materialize(reduce(DataFrame.union, marks), "spans")
    found = again.join(small(marked), ID).select("doc_id", "home", "places", "spans")
    found = found.groupBy("home", "doc_id").agg(F.collect_list(F.struct("places", "spans")).alias("marks"))
    found = materialize(found, "marks")
    drop(again, distinct, marked, *parts)
    return found


def merged(marks: list[dict], n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """Sorted disjoint byte ranges of a text of n bytes. A span is clipped to the text; one that is then shorter than
    ``length`` comes from a piece at the text's edge and covers nothing."""
    cuts: list[tuple[int, int]] = []
    for mark in marks:
        places = mark["places"]
        for span in mark["spans"]:
            start, end = span["start"], span["end"]
            if len(places) < MANY:
                near = [(max(0, p + start), min(n, p + end)) for p in places]
                cuts += [(a, b) for a, b in near if b - a >= length]
                continue
            # of a repetitive text, whose places lie side by side
            at = np.sort(np.asarray(places, np.int64))
            a, b = np.maximum(at + start, 0), np.minimum(at + end, n)
            a, b = a[b - a >= length], b[b - a >= length]
            if len(a):
                begins = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
                cuts += zip(a[begins].tolist(), b[np.append(begins[1:], len(a)) - 1].tolist(), strict=True)
    return united(cuts)


def merged_all(marks: pa.Array, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``merged`` of a column of marks at once, for texts of ``n`` bytes: text, first and end of each range, in order."""
    text = pc.list_parent_indices(marks).to_numpy(zero_copy_only=False)
    flat = marks.flatten()
    places, spans = flat.field("places"), flat.field("spans")
    of_span = pc.list_parent_indices(spans).to_numpy(zero_copy_only=False)
    count = places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    first_place = np.cumsum(count) - count
    place, span = places.flatten().to_numpy(zero_copy_only=False).astype(np.int64), spans.flatten()
    each = count[of_span]
    row = np.repeat(np.arange(len(of_span)), each)
    own = of_span[row]
    at = place[first_place[own] + np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)]
    start, end = (span.field(c).to_numpy(zero_copy_only=False).astype(np.int64)[row] for c in ("start", "end"))
    doc = text[own]
    a, b = np.maximum(at + start, 0), np.minimum(at + end, n[doc])
    good = np.flatnonzero(b - a >= length)
    # texts one after the other, apart
    base = np.cumsum(n + 2) - (n + 2)
    a, b = a[good] + base[doc[good]], b[good] + base[doc[good]]
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    begins = np.flatnonzero(np.append(True, a[1:] > b[:-1])[: len(a)])
    first, last = a[begins], b[np.append(begins[1:], len(a))[: len(begins)] - 1]
    doc = np.searchsorted(base, first, side="right") - 1
    return doc, first - base[doc], last - base[doc]


def _split(docs: DataFrame, marks: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """Documents that surely have no mark (None if that would need too large a broadcast), and the others with marks."""
    rest = None
    if rows_of(marks) <= BROADCAST_KEYS:
        homes = F.broadcast(marks.select("home").distinct())
        rest, docs = docs.join(homes, "home", "left_anti"), docs.join(homes, "home", "left_semi")
    other = marks.withColumnsRenamed({"home": "m_home", "doc_id": "m_doc_id"})
    joined = docs.join(other, (docs["home"] == other["m_home"]) & docs["doc_id"].eqNullSafe(other["m_doc_id"]), "left")
    return rest, joined.drop("m_home", "m_doc_id")


def _both_marks(docs: DataFrame, length: int, least: int | None) -> DataFrame:
    """(home, doc_id, marks, word_marks) of the documents with repeated strings or runs of ``least`` words."""
    marks = find_repeats(docs, length)
    if not least:
        return marks.withColumn("word_marks", F.lit(None).cast(marks.schema["marks"].dataType))
    keep = 1 << (CODE * least - 1).bit_length() - 1
    own = find_repeats(word_codes(docs), CODE * least, keep)
    both = marks.unionByName(own.withColumnRenamed("marks", "word_marks"), allowMissingColumns=True).groupBy("home", "doc_id")
    both = materialize(both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("marks", "word_marks")]), "marks")
    drop(marks, own)
    return both


def repeat_report(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, least: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what is left. With ``least`` also
    n_passages: how many maximal runs of at least that many words repeat, whatever their bytes (see ``remove_repeats``);
    they are reported, not removed.

    Null texts are empty ones; texts shorter than ``length`` lose nothing. Repeated rows count as separate documents,
    so both lose what they share. Other columns of ``docs`` are ignored; an empty table gives no rows."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("home", F.xxhash64("text"))
    rest, marked = _split(docs, _both_marks(docs, length, least))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["n_passages"] * bool(least)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [value.as_py() for value in batch.column(1)]
            doc, first, last = merged_all(batch.column(2), np.array([len(x) for x in raws], np.int64), length)
            begin = np.searchsorted(doc, np.arange(len(raws) + 1))
            passages = np.zeros(len(raws), np.int64)
            if least:
                # a run of words from the first whole one on; the number of words is all that the text decides
                n = [CODE * len(x.split()) if has else 0 for x, has in zip(raws, batch.column(3).is_valid().to_pylist(), strict=True)]
                of_words, a, b = merged_all(batch.column(3), np.array(n, np.int64), CODE * least)
                passages += np.bincount(of_words[b // CODE + -a // CODE >= least], minlength=len(raws))
            out = []
            for i, raw in enumerate(raws):
                own = slice(begin[i], begin[i + 1])
                cuts = list(zip(first[own].tolist(), last[own].tolist(), strict=True))
                kept, at = hashlib.sha256(), 0
                for a, b in cuts:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                out.append((len(raw), sum(b - a for a, b in cuts), len(cuts), kept.hexdigest(), int(passages[i])))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds[: len(names) - 1]))], names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", n_passages long" * bool(least)
    result = marked.select("doc_id", F.col("text").cast("binary").alias("text"), "marks", "word_marks").mapInArrow(tidy(run), schema)
    if rest is not None:
        zero = F.lit(0).cast("long")
        result = result.union(rest.select("doc_id", F.octet_length("text").cast("long"), zero, zero, F.sha2(F.col("text").cast("binary"), 256), *[zero] * (len(names) - 5)))
    return result


def word_codes(docs: DataFrame) -> DataFrame:
    """(doc_id, home, text) with CODE bytes for each word of the text, so that equal runs of words are equal strings."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            out: list[bytes] = []
            for first, last in pieces(offsets, 1 << 19):
                _, _, value, begin = words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                raw = value.astype("<u4").tobytes()
                out += [raw[CODE * a : CODE * b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc_id", "home", "text"])

    return docs.select("doc_id", "home", "text").mapInArrow(tidy(run), "doc_id long, home long, text binary")


def word_cuts(raw: bytes, marks: list[dict], least: int) -> list[tuple[int, int]]:
    """Byte ranges of a text, from the marks of its word codes; each goes from a word's start to a word's end."""
    data = np.frombuffer(raw, np.uint8)
    start, end, _, _ = words(data, np.array([0, len(data)]))
    whole = [(-(-a // CODE), b // CODE) for a, b in merged(marks, CODE * len(start), CODE * least)]
    return [(int(start[i]), int(end[j - 1])) for i, j in whole if j - i >= least]


def united(cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(cuts)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, least: int | None = None) -> DataFrame:
    """``docs`` with the repeated bytes of ``text`` cut out; all columns and rows stay.

    With ``least``, runs of that many words that repeat are cut too, however few their bytes: words are parted by white
    space, which itself plays no part, and A-Z count as a-z.
    A character of which only a part is covered stays, so the text remains valid UTF-8. A null text stays null."""
    others = [c for c in docs.columns if c != text]
    inner = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.struct(*others, F.lit(0).alias("_")).alias("row"))
    inner = inner.withColumn("home", F.xxhash64("text"))
    rest, marked = _split(inner, _both_marks(inner.drop("row"), length, least))

    @F.pandas_udf(T.StringType())
    def cut(texts, marks, word_marks):  # noqa: ANN001, ANN202
        out = []
        for value, own, of_words in zip(texts, marks, word_marks, strict=True):
            if value is None or own is None and of_words is None:
                out.append(value)
                continue
            raw = value.encode()
            parts, at = [], 0
            cuts = [] if own is None else merged(list(own), len(raw), length)
            if of_words is not None:
                cuts = united(cuts + word_cuts(raw, list(of_words), least))
            for a, b in cuts:
                while a < b and raw[a] & 0xC0 == 0x80:
                    a += 1
                while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                    b -= 1
                parts.append(raw[at:a])
                at = b
            out.append((b"".join(parts) + raw[at:]).decode())
        return texts.__class__(out, dtype=object)

    after = marked.withColumn("text", F.when(F.col("marks").isNull() & F.col("word_marks").isNull(), F.col("text")).otherwise(cut("text", "marks", "word_marks"))).select("row", "text")
    if rest is not None:
        after = after.union(rest.select("row", "text"))
    return after.select(*[F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
