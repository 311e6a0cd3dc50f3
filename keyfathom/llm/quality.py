"""Quality classifier: histogram gradient-boosted trees over document statistics.

Features are binned by quantiles of the training sample; a node's split comes from histograms of gradients and
hessians. The trees are flattened into arrays, and numpy walks all documents down a tree together."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfathom.llm.samples import fold, labelled
from keyfathom.llm.textbytes import SPACE, pieces, utf8, words
from keyfathom.llm.workers import tidy

#: Training documents, and bytes of their texts.
SAMPLE = 8000
SAMPLE_BYTES = 256 << 20
BINS = 64
TREES = 60
DEPTH = 4
RATE = 0.15

_CLASSES = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": [9, 10, 11, 12, 13, 32], "line": [10],
    "stop": [ord(c) for c in ".,;:'\"-()"], "loud": [ord(c) for c in "!?"], "odd": [ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"],
    "wide": range(128, 256), "control": [*range(9), *range(14, 32), 127],
}
_MASK = np.stack([np.isin(np.arange(256), list(c)) for c in _CLASSES.values()], axis=1).astype(np.float64)
FEATURES = ["log_bytes", *(f"share_{c}" for c in _CLASSES), "entropy", "log_words", "word_length", "word_spread", "distinct", "most_common", "repeats", "distinct_pairs", "capitalised", "odd_words", "line_words", "same_lines"]


def features(column: pa.Array) -> np.ndarray:
    """Statistics of each text (len, FEATURES); an empty or null text has zeros."""
    data, offsets = utf8(column)
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    for first, last in pieces(offsets, 1 << 20):
        a = offsets[first]
        part, at = data[a : offsets[last]], offsets[first : last + 1] - a
        start, end, h, word_at = words(part, at)
        length = end - start
        lead = part[start] if len(start) else np.zeros(0, np.uint8)
        capital = (lead >= 65) & (lead <= 90)
        odd_sum = np.concatenate(([0], np.cumsum(_MASK[part, 7].astype(np.int64))))
        odd = odd_sum[end] > odd_sum[start]
        for i in range(last - first):
            n = int(at[i + 1] - at[i])
            if not n:
                continue
            row = out[first + i]
            own = part[at[i] : at[i + 1]]
            seen = np.bincount(own, minlength=256)
            row[0] = np.log1p(n)
            row[1 : 1 + len(_CLASSES)] = seen @ _MASK / n
            p = seen[seen > 0] / n
            x, y = int(word_at[i]), int(word_at[i + 1])
            m = y - x
            rest = [float(-(p * np.log(p)).sum()), np.log1p(m)]
            if m:
                mine = h[x:y]
                ordered = np.sort(mine)
                edges = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))
                pairs = np.sort(mine[:-1] * np.uint64(3) + mine[1:]) if m > 1 else ordered
                breaks = np.cumsum(own == 10)[np.maximum(start[x:y] - at[i], 0)]
                lines = np.flatnonzero(np.concatenate(([True], np.diff(breaks) > 0)))
                sums = np.add.reduceat(mine * (np.arange(m, dtype=np.uint64) - np.repeat(lines, np.diff(np.append(lines, m))).astype(np.uint64) + np.uint64(1)), lines)
                rest += [
                    length[x:y].mean(), length[x:y].std(), (len(edges) - 1) / m, np.diff(edges).max() / m,
                    (mine[1:] == mine[:-1]).mean() if m > 1 else 0.0, (1 + (pairs[1:] != pairs[:-1]).sum()) / len(pairs),
                    capital[x:y].mean(), odd[x:y].mean(), m / len(lines), 1 - len(np.unique(sums)) / len(lines),
                ]
                row[1 + len(_CLASSES) :] = rest
            else:
                row[1 + len(_CLASSES) : 3 + len(_CLASSES)] = rest
    return out


@dataclass
class Forest:
    """Nodes of all trees in one set of arrays; a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, pull: float = 1.0, least: int = 10) -> Forest:
    """Fit to labels 0 and 1. Without rows every score is 0.5, with one label the (smoothed) prior."""
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else 0.0
    parts: list[list[float]] = [[], [], [], [], []]
    roots: list[int] = []

    def leaf(value: float) -> int:
        i = len(parts[0])
        for part, v in zip(parts, (0, 0.0, i, i, value), strict=True):
            part.append(v)
        return i

    if len(y) and y.min() != y.max():
        edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS, method="lower")) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        flat = binned + BINS * np.arange(x.shape[1])
        z = np.full(len(y), base)

        def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> int:
            value = -RATE * g[rows].sum() / (h[rows].sum() + pull)
            if depth == DEPTH or len(rows) < 2 * least:
                z[rows] += value
                return leaf(value)
            shape, cells = (x.shape[1], BINS), flat[rows].ravel()
            size = x.shape[1] * BINS
            grad, hess, count = (np.bincount(cells, np.repeat(w, x.shape[1]), minlength=size).reshape(shape).cumsum(axis=1) for w in (g[rows], h[rows], np.ones(len(rows))))
            all_g, all_h, n = grad[:, -1:], hess[:, -1:], len(rows)
            gain = grad**2 / (hess + pull) + (all_g - grad) ** 2 / (all_h - hess + pull) - all_g**2 / (all_h + pull)
            gain[(count < least) | (n - count < least)] = -1
            j, b = divmod(int(gain.argmax()), BINS)
            if gain[j, b] <= 1e-9:
                z[rows] += value
                return leaf(value)
            i = leaf(value)
            down = binned[rows, j] <= b
            parts[0][i], parts[1][i] = j, float(edges[j][b])
            parts[2][i], parts[3][i] = grow(rows[down], g, h, depth + 1), grow(rows[~down], g, h, depth + 1)
            return i

        for _ in range(trees):
            p = 1 / (1 + np.exp(-z))
            roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0))
    kinds = (np.int32, np.float64, np.int32, np.int32, np.float64)
    return Forest(*(np.array(part, kind) for part, kind in zip(parts, kinds, strict=True)), np.array(roots, np.int32), base)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> Forest:
    """Train on about ``sample`` documents outside the held-out fold (3, 1), of at most ``most`` bytes in all; only
    their statistics reach the driver.

    Null texts, labels and ids are left out, an empty text trains with all statistics zero, and a repeated row as often
    as it occurs. Without rows every score is 0.5."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    rows = labelled(docs, labels, "quality", 3, 1, sample, most).select("doc_id", "label", "text").mapInArrow(tidy(run), "doc_id long, label int, x array<double>").toArrow().sort_by("doc_id")
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return boost(x, rows.column("label").to_numpy().astype(np.int64))


def score(docs: DataFrame, forest: Forest, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Null texts count as empty ones, which have all
    statistics zero. Repeated rows give repeated results; other columns are ignored."""
    held = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = held.value.score(features(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[key, "score", "predicted"])

    found = docs.select(F.col(key).cast("long").alias(key), F.col(text)).mapInArrow(tidy(run), f"{key} long, score double, predicted int")
    return found.select(key, F.coalesce(fold(key, 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
