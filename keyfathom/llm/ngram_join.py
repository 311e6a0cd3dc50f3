"""N-gram Jaccard self-join: documents whose sets of five-word shingles have a similarity of 0.8 or more.

Shingles are tokens; hashed into GROUPS groups, a document is a point of group counts. Points are packed into an R-tree
whose nodes hold coordinate maxima; the sum of coordinate minima of a query and a node bounds the overlap with any
document below. A pair that passes must also have parity bitmaps that differ in no more bits than similar sets differ in
tokens. Pairs that survive are verified on the sets.

Trees need documents that may match in one place. Two sets with similarity t or more share at least c tokens among the
first n - ceil(t n) + c of either under any common order. So documents meet by the tokens of their prefixes (c = 1), very
common ones ordered last, and those that share fewer than c tokens with any others at c = 1 + n / 10 can have no
partner. In each of a few rounds, every document with a prefix token at which different groups still meet sends its
point to one meeting, at one such token; meetings that grow beyond MEETING rows are salted and share a pivot. A tree over
the meeting gives candidates, of which a forest is verified; what links is contracted into groups. A forest of the
candidates at each prefix token where different groups are left joins those that no meeting brought together. Then trees
give all remaining pairs at such tokens, each pair at the first of the tokens that both are known to have; of a token's
largest group each row is in one tree only. So no pair is lost, and a group of n copies costs about n verifications. Equal
sets are one document throughout. Sets are made again from the texts of candidates, so only points and names are dealt by
token."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyfathom.llm.runs import components, key_runs
from keyfathom.llm.storage import BROADCAST_KEYS, drop, fitting, materialize, rows_of, small
from keyfathom.llm.textbytes import as_long, mix, pieces, utf8, words
from keyfathom.llm.workers import tidy

GROUPS = 128
PARITY_BITS = 2048
#: Bytes of a point before its second bitmap.
HEAD = GROUPS + PARITY_BITS // 8 + 1
MEETING = 250
ROUNDS = 2
BUCKET = 4096
#: Tokens by which a document tells where it has met another one before; a pair without a common one is told at each token.
KNOWN = 16
LEAF = 16
#: Tokens in more than this share of a block of documents count as common.
COMMON = 0.002
BLOCK_TOKENS = 2_000_000
MOST_COMMON = 200_000
#: Sets that a task remembers to have seen, and pairs that it holds.
SEEN = 100_000
PAIRS = 50_000
SIZE = 5
_MULTIPLIERS = mix(np.arange(1, SIZE + 2, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes; with fewer words than SIZE, one for the whole sequence."""
    data, offsets = utf8(column)
    for first, last in pieces(offsets, 1 << 20):
        a = offsets[first]
        _, _, h, at = words(data[a : offsets[last]], offsets[first : last + 1] - a)
        n = len(h)
        if n >= SIZE:
            s = np.zeros(n - SIZE + 1, np.uint64)
            for j in range(SIZE):
                s += h[j : n - SIZE + 1 + j] * _MULTIPLIERS[j]
            s = mix(s)
        for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if y - x >= SIZE:
                u = np.sort(s[x : y - SIZE + 1])
                yield u[np.concatenate(([True], u[1:] != u[:-1]))]
            elif y > x:
                yield mix((h[x:y] * _MULTIPLIERS[: y - x]).sum(keepdims=True) + np.array([y - x], np.uint64) * _MULTIPLIERS[SIZE])
            else:
                yield np.zeros(0, np.uint64)


def fingerprint(tokens: np.ndarray) -> int:
    """A 64-bit name of a set; distinct sets share one with a chance of 2**-64 a pair."""
    return int(as_long(mix(mix(tokens ^ np.uint64(0x2545F4914F6CDD1D)).sum(keepdims=True) + np.array([len(tokens)], np.uint64)))[0])


def needed(a, b):  # noqa: ANN001, ANN201
    """Nine times the overlap that sets of sizes a and b need: 100 i >= 80 (a + b - i)."""
    return 4 * (a + b)


class CountTree:
    """An R-tree packed by sort-tile over points of group counts (m, GROUPS) with their sums."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        m = len(sizes)
        order = np.argsort(sizes, kind="stable")
        slab = max(LEAF, int(np.ceil(np.sqrt(m / LEAF))) * LEAF)
        for a in range(0, m, slab):
            own = order[a : a + slab]
            axis = int(points[own].var(axis=0).argmax())
            order[a : a + slab] = own[np.argsort(points[own, axis], kind="stable")]
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        top, low, high = self.points, self.sizes, self.sizes
        while len(low) > LEAF:
            at = np.arange(0, len(low), LEAF)
            top, low, high = np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((top, low, high))

    def near(self, point: np.ndarray, size: int) -> np.ndarray:
        """Positions (in ``order``) of the points whose bound reaches the overlap needed."""
        spots: np.ndarray | None = None
        for top, low, high in reversed(self.levels):
            if spots is None:
                spots = np.arange(len(low))
            else:
                spots = (spots[:, None] * LEAF + np.arange(LEAF)).ravel()
                spots = spots[spots < len(low)]
            bound = np.minimum(top[spots], point).sum(axis=1, dtype=np.int64)
            least = np.maximum(low[spots], -(-4 * size // 5))
            spots = spots[(9 * bound >= needed(size, least)) & (5 * high[spots] >= 4 * size) & (4 * low[spots] <= 5 * size)]
            if not len(spots):
                return spots
        if spots is None:
            spots = np.arange(len(self.sizes))
        else:
            spots = (spots[:, None] * LEAF + np.arange(LEAF)).ravel()
            spots = spots[spots < len(self.sizes)]
        bound = np.minimum(self.points[spots], point).sum(axis=1, dtype=np.int64)
        return spots[9 * bound >= needed(size, self.sizes[spots])]


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 5 * len(x) < 4 * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return 9 * int((y[at] == x).sum()) >= needed(len(x), len(y))


def forest(points: np.ndarray, bits: np.ndarray, fine: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, asks: np.ndarray, block: int) -> list[tuple[int, int]]:
    """Pairs of documents that the tree can't tell apart, as a forest: candidates of one another are connected, documents
    of one label are connected from the start, and a document that asks takes the nearest candidate of each other tree."""
    label = np.unique(labels, return_inverse=True)[1]
    found: list[tuple[int, int]] = []
    tree = CountTree(points, sizes)
    for at, i in enumerate(tree.order):
        if not asks[i]:
            continue
        spots = tree.near(points[i], int(sizes[i]))
        near = tree.order[spots[(spots > at) | ~asks[tree.order[spots]]]]
        near = close(bits, sizes, i, near[label[near] != label[i]])
        for j in near[np.argsort(gaps(bits, i, near), kind="stable")].tolist():
            if label[i] != label[j] and closer(fine, sizes, i, j):
                label[label == label[j]] = label[i]
                found.append((int(i), j))
    return found


def apart(points: np.ndarray, bits: np.ndarray, fine: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, asks: np.ndarray, block: int) -> Iterator[tuple[int, int]]:
    """All pairs of different labels that the tree can't tell apart. The largest label's documents only answer, so a
    group of copies costs as much as it has rows. Documents that ask are in all blocks; the first gives their pairs."""
    tree = CountTree(points, sizes)
    for i in np.flatnonzero(asks).tolist():
        near = tree.order[tree.near(points[i], int(sizes[i]))]
        near = near[(labels[near] != labels[i]) & (~asks[near] | ((near > i) & (block == 0)))]
        for j in close(bits, sizes, i, near).tolist():
            if closer(fine, sizes, i, j):
                yield i, j


def _parity(tokens: np.ndarray, bits: int) -> bytes:
    return np.packbits((np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def point(tokens: np.ndarray) -> bytes:
    """Group counts of a set, its parity bitmap, and a shift: the counts kept are rounded up to multiples of its power of
    two, so that each fits a byte and minima of them still bound an overlap. A set of more tokens than the bitmap has
    bits has a second one of as many bits at least."""
    n = np.bincount((tokens >> np.uint64(57)).astype(np.int64), minlength=GROUPS)
    shift = 0
    while -(-int(n.max()) >> shift) > 255:
        shift += 1
    fine = _parity(tokens, 1 << (len(tokens) - 1).bit_length()) if len(tokens) > PARITY_BITS else b""
    return (-(-n >> shift)).astype(np.uint8).tobytes() + _parity(tokens, PARITY_BITS) + bytes([shift]) + fine


def points_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Counts (rows, GROUPS) and bitmaps as 64-bit words."""
    rows = np.frombuffer(b"".join([p[:HEAD] for p in column.to_pylist()]), np.uint8).reshape(-1, HEAD)
    n = rows[:, :GROUPS].astype(np.int32) << rows[:, -1:].astype(np.int32)
    return n, np.ascontiguousarray(rows[:, GROUPS:-1]).view(np.uint64)


def fine_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The second bitmaps, empty for sets without one."""
    return [np.frombuffer(p, np.uint8, offset=HEAD) for p in column.to_pylist()]


def differ(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two bitmaps differ, the longer one folded to the length of the other; tokens that only one set has
    are as many at least."""
    if len(x) < len(y):
        x, y = y, x
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0) ^ y).sum())


def gaps(bits: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Bits in which the bitmaps of ``others`` differ from i's: each is a token that only one of the two has."""
    return np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64)


def close(bits: np.ndarray, sizes: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Those of ``others`` that differ from i in few enough bits."""
    return others[9 * gaps(bits, i, others) <= sizes[others] + sizes[i]]


def closer(fine: list[np.ndarray], sizes: np.ndarray, i: int, j: int) -> bool:
    """Whether the second bitmaps, if both have one, differ in few enough bits."""
    return not len(fine[i]) or not len(fine[j]) or 9 * differ(fine[i], fine[j]) <= sizes[i] + sizes[j]


def prefix_length(n, extra):  # noqa: ANN001, ANN201
    """Tokens in which two sets of similarity 0.8 share ``extra``, for a set of n."""
    return n - (4 * n + 4) // 5 + extra


def _common_tokens(docs: DataFrame) -> np.ndarray:
    """Tokens in a large share of the distinct sets, at most MOST_COMMON; they only order prefixes, so an estimate does."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        size = docs_in = 0

        def flush() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= max(8, COMMON * docs_in)
            return pa.RecordBatch.from_arrays([pa.array([None, *as_long(token[keep]).tolist()], pa.int64()), pa.array([docs_in, *n[keep].tolist()], pa.int64()), pa.array([size, *[0] * int(keep.sum())], pa.int64())], names=["token", "n", "total"])

        for batch in batches:
            for tokens in shingle_sets(batch.column(0)):
                if len(tokens) and (name := fingerprint(tokens)) not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(name)
                    held.append(tokens)
                    size, docs_in = size + len(tokens), docs_in + 1
                if size >= BLOCK_TOKENS:
                    yield flush()
                    held, size, docs_in = [], 0, 0
        if held:
            yield flush()

    found = materialize(docs.select("text").mapInArrow(tidy(run), "token long, n long, total long").groupBy("token").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "common")
    whole = found.where("token is null").first()
    if whole is None:
        return np.zeros(0, np.uint64)
    # a token counts once a set, so at most total / least tokens pass: no more than MOST_COMMON
    least = max(8, COMMON * whole.n, whole.total / MOST_COMMON)
    rows = found.where(F.col("token").isNotNull() & (F.col("n") >= least)).select("token").toArrow()
    return np.sort(rows.column(0).to_numpy().view(np.uint64))


def _sets(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """(doc_id, home, n, name) per row; the point and the prefix, its common tokens apart, for the first row of a set in
    its task, or a few of its rows in a task of more than SEEN sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            n, names, points, rare, often = [], [], [], [], []
            for tokens in shingle_sets(batch.column(2)):
                size = len(tokens)
                n.append(size)
                name = fingerprint(tokens) if size else None
                names.append(name)
                if name is None or name in seen:
                    points.append(None)
                    rare.append(None)
                    often.append(None)
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(name)
                points.append(point(tokens))
                hot = np.zeros(size, bool)
                if len(common):
                    at = np.searchsorted(common, tokens)
                    at[at == len(common)] = 0
                    hot = common[at] == tokens
                length = prefix_length(size, 1 + size // 10)
                rare.append(as_long(tokens[~hot][:length]))
                often.append(as_long(tokens[hot][: max(0, length - len(rare[-1]))]))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(names, pa.int64()), pa.array(points, pa.binary()), pa.array(rare, longs), pa.array(often, longs)], names=["doc_id", "home", "n", "name", "point", "rare", "often"])

    return docs.select("doc_id", "home", "text").mapInArrow(tidy(run), "doc_id long, home long, n long, name long, point binary, rare array<long>, often array<long>")


def _token_sets(rows: DataFrame) -> DataFrame:
    """(name, tokens) once for each wanted name, of rows (name, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(0).to_pylist()
            out = [(w, t.tobytes()) for w, t in zip(wanted, shingle_sets(batch.column(1)), strict=True) if len(t) and fingerprint(t) == w]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.binary()))], names=["name", "tokens"])

    return rows.select("name", "text").mapInArrow(tidy(run), "name long, tokens binary")


def _candidates(pick):  # noqa: ANN001, ANN202
    """Runs of (meeting, part, name, label, n, point) to the pairs of names (a < b) that ``pick`` gives for each run.

    All rows ask, or those that a column ``asks`` marks. With a column ``known``, some of the meetings of each name, a pair
    that has an earlier one of them in common is left to that one."""

    def out(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
        rows = sorted(pairs)
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: set[tuple[int, int]] = set()
        for group in key_runs(batches, 2):
            names, keep = np.unique(group.column("name").to_numpy(), return_index=True)
            labels = group.column("label").to_numpy()[keep]
            if (labels == labels[0]).all():
                continue
            own = group.column("point").take(pa.array(keep))
            asks = group.column("asks").to_numpy()[keep] if "asks" in group.column_names else np.ones(len(keep), bool)
            meeting, block = (group.column(i)[0].as_py() for i in (0, 1))
            known: list[set[int]] = []
            for i, j in pick(*points_of(own), fine_of(own), group.column("n").to_numpy()[keep], labels, asks, block):
                if "known" in group.column_names:
                    known = known or [set(k) for k in group.column("known").take(pa.array(keep)).to_pylist()]
                    if min(known[i] & known[j], default=meeting) < meeting:
                        continue
                pairs.add((int(min(names[i], names[j])), int(max(names[i], names[j]))))
                if len(pairs) >= PAIRS:
                    yield out(pairs)
                    pairs.clear()
        yield out(pairs)

    return run


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        keep = [similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(x, y, strict=True)]
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _verified(docs: DataFrame, home: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that are similar; each set is made from its text again and sent to its pairs."""
    names = fitting(pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct(), 2 * rows_of(pairs), "names")
    home = materialize(home.join(names, "name", "left_semi"), "homes")
    wanted = docs
    if rows_of(home) <= BROADCAST_KEYS:
        wanted = docs.join(F.broadcast(home.select("home").distinct()), "home", "left_semi")
    held = wanted.join(small(home), (wanted["home"] == home["home"]) & wanted["doc_id"].eqNullSafe(home["at"])).select("name", "text")
    held = materialize(_token_sets(held), "tokens")
    if rows_of(held) > rows_of(home):  # rows that occur twice
        twice, held = held, materialize(held.dropDuplicates(["name"]), "tokens")
        drop(twice)
    y = held.join(small(pairs), held["name"] == pairs["b"]).select("a", "b", F.col("tokens").alias("y"))
    x = held.select(F.col("name").alias("a"), F.col("tokens").alias("x"))
    links = materialize(y.join(x, "a").select("a", "b", "x", "y").mapInArrow(tidy(_verify), "a long, b long"), "links")
    drop(home, held)
    return links


def _contracted(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (name, label) after joining the labels that ``links`` (a, b) connect."""
    low, high = small(labels).toDF("a", "la"), small(labels).toDF("b", "lb")
    roots = components(links.join(low, "a").join(high, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    after = labels.join(small(roots).withColumnRenamed("node", "label"), "label", "left").select("name", F.coalesce("root", "label").alias("label"))
    after = materialize(after, "labels")
    drop(links, roots)
    return after


def _dealt(meetings: DataFrame, labels: DataFrame, held: DataFrame, known: int) -> DataFrame:
    """(token, block, name, label, n, point, asks) for the tokens at which rows of several labels meet; with ``known``,
    also the least so many of these tokens that the name has.

    A row of the label with most rows at a token goes to one block of it, any other row asks and goes to all."""
    labelled = meetings.join(small(labels), "name")
    split = labelled.groupBy("token", "label").agg(F.count("*").alias("n"))
    split = split.groupBy("token").agg(F.sum("n").alias("rows"), F.max(F.struct("n", "label")).alias("most")).where("rows > most.n")
    blocks = F.ceil(F.col("rows") / BUCKET).cast("int")
    split = fitting(split.select("token", blocks.alias("blocks"), F.col("most.label").alias("most")), rows_of(meetings), "split")
    asks = F.col("label") != F.col("most")
    own = F.array(F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    places = F.when(asks, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own)
    left = labelled.join(split, "token").select("token", F.explode(places.cast("array<long>")).alias("block"), "name", "label", asks.alias("asks"))
    columns = ["token", "block", "name", "label", "n", "point", "asks"]
    if known:
        least = meetings.join(split, "token", "left_semi").groupBy("name").agg(F.slice(F.array_sort(F.collect_set("token")), 1, known).alias("known"))
        held, columns = held.join(least, "name"), [*columns, "known"]
    return left.join(held, "name").select(*columns)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id it is linked to, itself included),
    text_hash, the xxhash64 of its text, and first, whether it is the least of its group by (doc_id, text_hash), a null
    doc_id last.

    Null, empty and blank texts have no shingles and are linked with nothing, not even each other. Repeated rows are
    one set and come out as often as they came in. A null doc_id stays null and is no component's smallest unless it is
    alone. Other columns of ``docs`` are ignored; an empty table gives no rows."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    docs = docs.withColumn("home", F.xxhash64("text"))
    made = materialize(_sets(docs, _common_tokens(docs)), "made")
    sets = materialize(made.select("doc_id", "home", "n", "name"), "sets")

    # (token, name, early): the prefix tokens that several sets have
    head = F.col("n") - F.floor((4 * F.col("n") + 4) / 5) + 1
    rare = made.where(F.col("rare").isNotNull()).select("name", head.alias("head"), F.posexplode("rare").alias("at", "token"))
    rare = rare.select("token", "name", (F.col("at") < F.col("head")).alias("early"))
    own = Window.partitionBy("token").orderBy("name")
    every = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rare = rare.withColumns({"before": F.lag("name").over(own), "x": F.first("name").over(every), "y": F.last("name").over(every)})
    rare = rare.where((F.col("x") < F.col("y")) & ~F.col("name").eqNullSafe(F.col("before"))).select("token", "name", "early")
    often = made.where(F.col("often").isNotNull()).select("name", head.alias("head"), F.size("rare").alias("skip"), F.posexplode("often").alias("at", "token"))
    often = often.select("token", "name", (F.col("at") + F.col("skip") < F.col("head")).alias("early")).distinct()
    shared = materialize(rare.union(often), "shared")

    # who shares enough of them; tokens at which the same sets meet count once
    enough = shared.groupBy("name").agg(F.count("*").alias("c")).join(made.where(F.col("rare").isNotNull()).select("name", "n").distinct(), "name")
    enough = enough.where(F.col("c") >= 1 + F.floor(F.floor((4 * F.col("n") + 4) / 5) / 10)).select("name")
    early = materialize(shared.where("early").join(fitting(enough, rows_of(sets), "enough"), "name", "left_semi").select("token", "name"), "early")
    who = [F.bit_xor(F.xxhash64("name", F.lit(i))).alias(f"who{i}") for i in (0, 1)]
    tokens = early.groupBy("token").agg(F.min("name").alias("x"), F.max("name").alias("y"), F.count("*").alias("rows"), *who).where("x < y")
    tokens = materialize(tokens.groupBy("who0", "who1", "rows").agg(F.min("token").alias("token")).select("token"), "open")
    meetings = materialize(early.join(small(tokens), "token", "left_semi"), "meetings")
    labels = materialize(meetings.select("name").distinct().withColumn("label", F.col("name")), "labels")
    drop(shared, early, tokens)
    held = made.where(F.col("point").isNotNull()).select("name", "n", "point").join(small(labels), "name", "left_semi")
    held = materialize(held.dropDuplicates(["name"]), "points")
    home = sets.join(small(labels), "name", "left_semi").groupBy("name").agg(F.min(F.struct("home", "doc_id")).alias("h"))
    home = materialize(home.select("name", F.col("h.home").alias("home"), F.col("h.doc_id").alias("at")), "home")
    drop(made)

    kinds = "a long, b long"
    for turn in range(ROUNDS):
        labelled = meetings.join(small(labels), "name")
        open_ = fitting(labelled.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("token"), rows_of(meetings), "open")
        first = labelled.join(open_, "token", "left_semi").groupBy("name", "label").agg(F.min_by("token", F.xxhash64("token", F.lit(turn))).alias("meeting"))
        first = materialize(first, "first")
        sizes = first.groupBy("meeting").agg(F.ceil(F.count("*") / MEETING).cast("int").alias("salts"), F.min("name").alias("pivot"), F.min("label").alias("x"), F.max("label").alias("y"))
        sizes = fitting(sizes.where("x < y").drop("x", "y"), rows_of(labels), "sizes")
        salts = F.when(F.col("name") == F.col("pivot"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("name"), F.col("salts")).cast("int")))
        spread = first.join(sizes, "meeting").select("meeting", F.explode(salts.cast("array<long>")).alias("salt"), "name", "label")
        met = spread.join(held, "name").select("meeting", "salt", "name", "label", "n", "point")
        pairs = met.repartition("meeting", "salt").sortWithinPartitions("meeting", "salt").mapInArrow(tidy(_candidates(forest)), kinds)
        pairs = materialize(pairs.distinct(), "pairs")
        links = _verified(docs, home, pairs)
        drop(first, pairs)
        if links.isEmpty():
            break
        before, labels = labels, _contracted(labels, links)
        drop(before)

    # at any shared prefix token, first what links the groups there, then all pairs of different groups
    for pick in (forest, apart):
        left = _dealt(meetings, labels, held, KNOWN if pick is apart else 0)
        pairs = left.repartition("token", "block").sortWithinPartitions("token", "block").mapInArrow(tidy(_candidates(pick)), kinds)
        pairs = materialize(pairs.distinct(), "pairs")
        if pairs.isEmpty():
            drop(pairs)
            break
        before, labels = labels, _contracted(labels, _verified(docs, home, pairs))
        drop(pairs, before)
    drop(meetings, held, home)

    # the least row of each group of more than one row
    names = sets.where(F.col("name").isNotNull()).groupBy("name").agg(F.count("*").alias("rows"), F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "home")).alias("least"))
    names = materialize(names.join(small(labels), "name", "left").select("name", F.coalesce("label", "name").alias("group"), "rows", "least"), "names")
    groups = names.groupBy("group").agg(F.sum("rows").alias("rows"), F.min("least").alias("least")).where("rows > 1").select("group", "least")
    groups = materialize(groups, "groups")
    member = materialize(names.join(small(groups).withColumnRenamed("least", "first"), "group").select(F.col("name").alias("of"), "first"), "member")
    drop(labels, names, groups)
    alone = F.col("first").isNull()
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("home").eqNullSafe(F.col("first.home"))
    # every row without a set has a key of its own, so that they spread
    found = sets.withColumn("of", F.coalesce("name", F.xxhash64("doc_id", "home"))).join(small(member), "of", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone | F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), F.col("home").alias("text_hash"), (alone | F.col("name").isNull() | same).alias("first"))
