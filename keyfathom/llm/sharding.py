"""Sharding: minimax contiguous partition of ordered atomic groups.

Groups are equal texts, ordered by the MD5 of the text. The smallest capacity that lets 40 (or n) runs of groups hold
everything is found by binary search with a greedy check, and the cuts are placed as evenly as it allows. Both need
prefix sums of group sizes; the driver holds
them for segments of the key order (65,536 at first, by leading hex digits) and opens only the segments in which a cut
can fall, until every such segment is a single group. What it holds is bounded by the number of segments, not groups."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyfathom.llm.storage import materialize

ROW_BYTES = 16
SALTS = 256


@dataclass
class Segment:
    prefix: str
    size: int
    groups: int
    largest: int


def _fill(segments: list[Segment], capacity: int, n: int, fluid: bool) -> list[int]:
    """Greedy ends of at most n runs, as sums of sizes. fluid: segments of several groups may be cut anywhere."""
    total = np.cumsum([s.size for s in segments])
    rigid = np.array([s.groups == 1 for s in segments])
    ends: list[int] = []
    at = 0
    for _ in range(n):
        reach = at + capacity
        k = int(np.searchsorted(total, reach, side="right"))
        if k == len(segments):
            ends.append(int(total[-1]))
            break
        stop = int(total[k - 1]) if k else 0
        if fluid and not rigid[k]:
            stop = reach
        if stop <= at:
            break
        ends.append(stop)
        at = stop
    return ends


def _least(segments: list[Segment], n: int, fluid: bool) -> int:
    """Smallest capacity at which the greedy check succeeds."""
    total = sum(s.size for s in segments)
    low = max(-(-total // n), max(s.largest if fluid else s.size for s in segments))
    high = max(total, low)
    while low < high:
        mid = (low + high) // 2
        ends = _fill(segments, mid, n, fluid)
        if ends and ends[-1] == total:
            high = mid
        else:
            low = mid + 1
    return low


def _ambiguous(segments: list[Segment], low: int, high: int, n: int) -> list[int]:
    """Segments of several groups in which a greedy cut may fall at some capacity from low to high."""
    sums = np.cumsum([s.size for s in segments])
    early, late = _fill(segments, low, n, False), _fill(segments, high, n, True)
    open_: set[int] = set()
    for k in range(len(late)):
        a = early[k] if k < len(early) else (early[-1] if early else 0)
        first, last = int(np.searchsorted(sums, a, side="right")), int(np.searchsorted(sums, late[k], side="left"))
        open_ |= {i for i in range(first, min(last, len(segments) - 1) + 1) if segments[i].groups > 1}
    return sorted(open_)


def _levels(segments: list[Segment], n: int) -> tuple[list[int], set[int]]:
    """Average sizes of a shard: of all groups, then without those groups that alone exceed it, and so on; and segments
    of several groups that hold a group above the last."""
    rest, levels, lone = sum(s.size for s in segments), [], set()
    while True:
        levels.append(-(-rest // (n - len(lone))))
        more = [i for i, s in enumerate(segments) if s.groups == 1 and s.size > levels[-1] and i not in lone]
        if not more or len(lone) + len(more) >= n:
            return levels, {i for i, s in enumerate(segments) if s.groups > 1 and s.largest > levels[-1]}
        lone.update(more)
        rest -= sum(segments[i].size for i in more)


def _runs(segments: list[Segment], level: int, n: int) -> list[tuple[int, int, int]] | None:
    """(first, last + 1, shards) of the stretches between groups larger than ``level``, each of which has a shard of its
    own; None if there are too few shards for that. The stretch with the largest shards gets each further shard."""
    large = [i for i, s in enumerate(segments) if s.groups == 1 and s.size > level]
    edges = [-1, *large, len(segments)]
    spans = [(a + 1, b) for a, b in zip(edges, edges[1:], strict=False) if b > a + 1]
    if len(spans) + len(large) > n:
        return None
    size = [sum(s.size for s in segments[a:b]) for a, b in spans]
    most = [sum(s.groups for s in segments[a:b]) for a, b in spans]
    share = [1] * len(spans)
    for _ in range(n - len(large) - len(spans)):
        open_ = [k for k in range(len(spans)) if share[k] < most[k]]
        if not open_:
            break
        share[max(open_, key=lambda k: size[k] / share[k])] += 1
    return sorted([(a, b, k) for (a, b), k in zip(spans, share, strict=True)] + [(i, i + 1, 1) for i in large])


def _even(segments: list[Segment], capacity: int, n: int) -> tuple[list[int], set[int]]:
    """Ends of n runs, as sums of sizes, each the nearest to what is left over the runs left, as far as no run exceeds
    the capacity; and the segments of several groups that decided one, so that it may not be exact."""
    sums = np.cumsum([s.size for s in segments])
    after = sum(s.groups for s in segments) - np.cumsum([s.groups for s in segments])
    total, unclear = int(sums[-1]), set()

    def opens(i: int) -> None:
        if i < len(segments) and segments[i].groups > 1:
            unclear.add(i)

    least = [total]  # where the k-th run from the end can begin at the earliest
    for _ in range(n - 1):
        want = least[-1] - capacity
        if want <= 0:
            least.append(0)
            continue
        i = int(np.searchsorted(sums, want, side="left"))
        if int(sums[i]) > want:
            opens(i)
        least.append(int(sums[i]))
    least.reverse()
    ends, at = [], 0
    for k in range(n - 1):
        ideal = at + (total - at) / (n - k)
        i = int(np.searchsorted(sums, ideal, side="left"))
        low, high = int(sums[i - 1]) if i else 0, int(sums[min(i, len(sums) - 1)])
        if high != ideal:
            opens(i)
        end = high if high - ideal <= ideal - low or low <= at else low
        j = int(np.searchsorted(sums, at + capacity, side="right"))
        if end > at + capacity:
            opens(j)
            end = int(sums[j - 1]) if j else at
        # a group at least for each run that follows
        spare = int(np.searchsorted(-after, -(n - 1 - k), side="right"))
        if end > (last := int(sums[spare - 1]) if spare else 0) > at:
            opens(spare)
            end = last
        end = min(max(end, least[k]), total)
        ends.append(end)
        at = end
    return [*ends, total], unclear


def minimax_cuts(groups: DataFrame, n: int, digits: int = 4, step: int = 2) -> tuple[int, list[str]]:
    """Capacity and the least key (a prefix of it) of each run but the first, over ``groups`` (key string, bytes long).

    The capacity is the least that suffices. Cuts also balance the rest: groups larger than an equal share of what other
    groups leave have a run of their own, and the stretches between them are cut evenly, as far as the capacity allows."""

    def opened(prefixes: list[str]) -> list[Segment]:
        size = len(prefixes[0]) if prefixes else 0
        rows = groups.where(F.substring("key", 1, size).isin(prefixes)) if prefixes else groups
        part = F.substring("key", 1, size + step if prefixes else digits).alias("p")
        found = rows.groupBy(part).agg(F.sum("bytes").alias("s"), F.count("*").alias("n"), F.max("bytes").alias("m")).collect()
        return [Segment(r.p, int(r.s), int(r.n), int(r.m)) for r in found]

    def even(runs: list[tuple[int, int, int]]) -> tuple[int, list[int], set[int]]:
        """Capacity, ends and unclear segments over runs of segments, each with its shards."""
        ends, unclear, most, before = [], set(), 0, 0
        for a, b, k in runs:
            own = segments[a:b]
            low, high = _least(own, k, True), _least(own, k, False)
            vague = set(_ambiguous(own, low, high, k))
            cuts, more = _even(own, high, k)
            unclear |= {a + i for i in vague or more}
            ends += [before + e for e in cuts]
            before += sum(s.size for s in own)
            most = max(most, high)
        return most, ends, unclear

    segments = sorted(opened([]), key=lambda s: s.prefix)
    if not segments:
        return 0, []
    while True:
        levels, unclear = _levels(segments, n)
        if not unclear:
            low, high = _least(segments, n, True), _least(segments, n, False)
            unclear = set(_ambiguous(segments, low, high, n))
        if not unclear:
            most = high + 1
            for level in reversed(levels):
                runs = _runs(segments, level, n)
                if runs and not unclear and most > high:
                    most, ends, unclear = even(runs)
            if not unclear and most > high:
                most, ends, unclear = even([(0, len(segments), n)])
        if not unclear:
            break
        by_length: dict[int, list[str]] = {}
        for i in unclear:
            by_length.setdefault(len(segments[i].prefix), []).append(segments[i].prefix)
        segments = [s for i, s in enumerate(segments) if i not in unclear]
        for prefixes in by_length.values():
            segments += opened(prefixes)
        segments.sort(key=lambda s: s.prefix)
    sums = np.cumsum([s.size for s in segments])
    starts = sorted({e for e in ends if e < int(sums[-1])})
    return high, [segments[int(np.searchsorted(sums, e, side="right"))].prefix for e in starts]


def shard(docs: DataFrame, n: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Deal documents to n shards by bytes, equal texts together.

    A document's size is the UTF-8 length of its text plus 16; a null text counts as an empty one and is grouped with
    it. Returns one row per input row, repeated rows included; no rows for an empty table. Slots are gapless from 0 in
    each shard. A group larger than an equal share has a shard of its own and sets the capacity; the other shards are as
    equal as whole groups allow. With fewer groups than shards the last shards are empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    sized = materialize(
        docs.select(
            F.col(key).cast("long").alias("doc_id"),
            (F.octet_length(body).cast("long") + ROW_BYTES).alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.md5(body.cast("binary")).alias("key"),
        ),
        "sized",
    )
    groups = materialize(sized.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    _, cuts = minimax_cuts(groups, n)
    starts = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<string>")
    placed = sized.withColumn("shard", F.size(F.filter(starts, lambda c: c <= F.col("key"))).cast("int"))
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALTS)).cast("int"))
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    # at most n * SALTS rows
    offsets = placed.groupBy("shard", "salt").agg(F.count("*").alias("rows")).select("shard", "salt", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "salt").orderBy("doc_id", "key")
    return placed.withColumn("nth", F.row_number().over(within)).join(F.broadcast(offsets), ["shard", "salt"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
