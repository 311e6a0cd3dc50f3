"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of those of its hash and of the hash of its first PREFIX bytes, which inflected and
compound forms share. Filters of several widths run over the embeddings of a text's words; the largest response of each filter feeds one
logistic unit. Gradients pass only through the words at which a filter is largest, so a step touches few embeddings.
The score's threshold is calibrated for each language group: a logistic fit on calibration rows sets slope and offset,
so that 0.5 is the threshold everywhere. The group is the language of the text. The learned model of ``language`` labels
the training texts; how much more often each word occurs in one language than in the others is then a table by the same
word hashes, and the language whose words weigh most is the text's."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfathom.llm import language as languages
from keyfathom.llm.samples import fold, labelled
from keyfathom.llm.textbytes import NO_WORD, pieces, utf8, words
from keyfathom.llm.workers import tidy

BUCKETS = 1 << 18
WIDTH = 8
FILTERS = 8
SPANS = (1, 2, 3)
PAD = max(SPANS) - 1
PREFIX = 6
#: Training documents, and bytes of their texts.
SAMPLE = 8000
SAMPLE_BYTES = 64 << 20
EPOCHS = 6
NETS = 3

def buckets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets (n, 2) of words and their beginnings in runs of texts, each text followed by PAD rows of BUCKETS, and where
    texts begin (len + 1)."""
    data, offsets = utf8(column)
    for first, last in pieces(offsets, 1 << 20):
        a = offsets[first]
        own, edges = data[a : offsets[last]], offsets[first : last + 1] - a
        _, _, h, at = words(own, edges, NO_WORD)
        start = ~words(own, edges, NO_WORD, PREFIX)[2]
        m = last - first
        begin = at + PAD * np.arange(m + 1)
        out = np.full((begin[-1], 2), BUCKETS, np.int32)
        out[np.arange(len(h)) + PAD * np.repeat(np.arange(m), np.diff(at))] = (np.stack((h, start), axis=1) >> np.uint64(46)).astype(np.int32)
        yield out, begin


def language_weights(ids: list[np.ndarray], languages: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Languages and, by bucket, the centred log shares of a word among each one's texts."""
    names = sorted({x for x in languages if x is not None})
    counts = np.full((BUCKETS + 1, max(len(names), 1)), 0.5, np.float32)
    for own, name in zip(ids, languages, strict=True):
        if name is not None:
            np.add.at(counts[:, names.index(name)], np.unique(own[:, 0]), 1)
    weights = np.log(counts / counts.sum(axis=0))
    weights -= weights.mean(axis=1, keepdims=True)
    weights[-1] = 0
    return names, weights.astype(np.float32)


@dataclass
class Model:
    embedding: np.ndarray  # (BUCKETS + 1, WIDTH), the last row zero
    filters: list[np.ndarray]  # per span (span, WIDTH, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    offset: float
    languages: list[str]
    weights: np.ndarray  # by bucket and language
    slope: np.ndarray  # by group: none, then the languages
    shift: np.ndarray


def _embed(model: Model, ids: np.ndarray) -> np.ndarray:
    return model.embedding[ids[:, 0]] + model.embedding[ids[:, 1]]


def _pool(model: Model, ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest responses (texts, all filters) and the words at which they begin."""
    m = len(begin) - 1
    x = _embed(model, ids)
    top, where = [], []
    doc = np.repeat(np.arange(m), np.diff(begin))
    for span, w in zip(SPANS, model.filters, strict=True):
        z = x[: len(x) - span + 1] @ w[0]
        for o in range(1, span):
            z += x[o : len(x) - span + 1 + o] @ w[o]
        z = np.concatenate((z, np.zeros((span - 1, FILTERS), np.float32)))
        best = np.maximum.reduceat(z, begin[:-1], axis=0)
        top.append(best)
        where.append((z, best))
    places = np.empty((m, len(SPANS) * FILTERS), np.int64)
    for k, (z, best) in enumerate(where):
        hits, column = np.nonzero(z == best[doc])
        places[doc[hits][::-1], k * FILTERS + column[::-1]] = hits[::-1]
    return np.concatenate(top, axis=1), places


def _respond(model: Model, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The logistic unit's input for each text."""
    x = _embed(model, ids)
    out = np.full(len(begin) - 1, model.offset, np.float32)
    for k, (span, w) in enumerate(zip(SPANS, model.filters, strict=True)):
        z = x[: len(x) - span + 1] @ w[0]
        for o in range(1, span):
            z += x[o : len(x) - span + 1 + o] @ w[o]
        z = np.concatenate((z, np.zeros((span - 1, FILTERS), np.float32)))
        part = slice(k * FILTERS, (k + 1) * FILTERS)
        out += np.maximum(np.maximum.reduceat(z, begin[:-1], axis=0) + model.bias[part], 0) @ model.out[part]
    return out


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit with a light pull towards (1, 0)."""
    a, b = 1.0, 0.0
    x = np.stack((z, np.ones(len(z))), axis=1)
    for _ in range(50):
        p = _logistic(a * z + b)
        g = x.T @ (p - y) + 0.5 * np.array([a - 1, b])
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return (float(a), float(b)) if a > 0 else (0.0, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))


def language_groups(model: Model, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """0 for texts without words, or without languages to tell; else 1 + the place of the language."""
    if not model.languages:
        return np.zeros(len(begin) - 1, np.int64)
    total = np.add.reduceat(model.weights[ids[:, 0]], begin[:-1], axis=0)
    return np.where(np.diff(begin) > PAD, total.argmax(axis=1) + 1, 0)


def train(ids: list[np.ndarray], y: np.ndarray, languages: list[str | None] | None = None, seed: int = 7, epochs: int = EPOCHS) -> Model:
    """Fit on texts as padded buckets, with their languages where known. Every fifth text only calibrates. Without both labels every score is the prior."""
    random = np.random.default_rng(seed)
    embedding = random.normal(0, 0.3, (BUCKETS + 1, WIDTH)).astype(np.float32)
    embedding[-1] = 0
    n = len(SPANS) * FILTERS
    names, weights = language_weights(ids, languages or [None] * len(ids))
    model = Model(
        embedding, [random.normal(0, (s * WIDTH) ** -0.5, (s, WIDTH, FILTERS)).astype(np.float32) for s in SPANS], np.zeros(n, np.float32),
        random.normal(0, 0.3, n).astype(np.float32), 0.0, names, weights, np.ones(len(names) + 1), np.zeros(len(names) + 1),
    )
    prior = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else 0.0
    if not len(y) or y.min() == y.max():
        model.slope[:], model.shift[:] = 0, prior
        return model
    spare = np.arange(len(y)) % 5 == 4
    fit = np.flatnonzero(~spare)
    positive = y[fit].mean()
    weight = np.where(y == 1, 0.5 / max(positive, 1e-3), 0.5 / max(1 - positive, 1e-3)).astype(np.float32)
    # Adagrad; only the embeddings a filter chose have a gradient
    squares = [np.full(p.shape, 1e-3, np.float32) for p in (model.embedding, *model.filters, model.bias, model.out, np.zeros(1))]
    offset = np.zeros(1, np.float32)
    for _ in range(epochs):
        random.shuffle(fit)
        for a in range(0, len(fit), 32):
            batch = fit[a : a + 32]
            flat = np.concatenate([ids[i] for i in batch])
            begin = np.concatenate(([0], np.cumsum([len(ids[i]) for i in batch])))
            top, places = _pool(model, flat, begin)
            hidden = top + model.bias
            active = hidden > 0
            p = _logistic(np.where(active, hidden, 0) @ model.out + model.offset)
            d = ((p - y[batch]) * weight[batch] / len(batch)).astype(np.float32)
            dh = d[:, None] * model.out * active
            grads: list[np.ndarray] = []
            rows, steps = [], []
            for k, (span, w) in enumerate(zip(SPANS, model.filters, strict=True)):
                part = slice(k * FILTERS, (k + 1) * FILTERS)
                g = np.zeros_like(w)
                for o in range(span):
                    at = np.minimum(places[:, part] + o, len(flat) - 1)
                    x = model.embedding[flat[at]].sum(axis=2)
                    g[o] = np.einsum("mf,mfd->df", dh[:, part], x)
                    rows.append(flat[at].ravel())
                    steps.append(np.repeat((dh[:, part, None] * w[o].T[None]).reshape(-1, WIDTH), 2, axis=0))
                grads.append(g)
            grads += [dh.sum(axis=0), np.where(active, hidden, 0).T @ d, np.array([d.sum()])]
            touched, inverse = np.unique(np.concatenate(rows), return_inverse=True)
            total = np.zeros((len(touched), WIDTH), np.float32)
            np.add.at(total, inverse, np.concatenate(steps))
            squares[0][touched] += total**2
            model.embedding[touched] -= 0.1 * total / np.sqrt(squares[0][touched])
            model.embedding[-1] = 0
            for value, g, s in zip((*model.filters, model.bias, model.out, offset), grads, squares[1:], strict=True):
                s += g**2
                value -= 0.1 * g / np.sqrt(s)
            model.offset = float(offset[0])
    flat = np.concatenate([ids[i] for i in np.flatnonzero(spare)]) if spare.any() else np.zeros((0, 2), np.int32)
    if len(flat):
        begin = np.concatenate(([0], np.cumsum([len(ids[i]) for i in np.flatnonzero(spare)])))
        z, g, own = _respond(model, flat, begin).astype(float), language_groups(model, flat, begin), y[spare]
        everywhere = _platt(z, own)
        for k in range(len(model.slope)):
            mine = g == k
            model.slope[k], model.shift[k] = _platt(z[mine], own[mine]) if mine.sum() >= 50 and 5 <= own[mine].sum() < mine.sum() - 5 else everywhere
    return model


def mean_response(models: list[Model], ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean of the networks' calibrated responses to each text, and its language group."""
    g = language_groups(models[0], ids, begin)
    z = [m.slope[g] * _respond(m, ids, begin).astype(float) + m.shift[g] for m in models]
    return np.mean(z, axis=0), g


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_BYTES, language: str = "lang") -> list[Model]:
    """Train NETS networks from different starts (a single one often ends with filters that miss some words) on about ``sample`` documents outside the held-out fold (5, 0), of at most ``most`` bytes in all; only
    their word buckets and predicted languages reach the driver.

    Null texts, labels and ids are left out, an empty text trains as one without words, and a repeated row as often as
    it occurs. Where ``docs`` has the column ``language`` a language model is learned from it; the texts alone decide
    afterwards. Without rows every score is 0.5."""
    speak = docs.sparkSession.sparkContext.broadcast(languages.train(docs, language=language) if language in docs.columns else None)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = languages.Labeller(speak.value) if speak.value else None
        for batch in batches:
            out = [ids[begin[i] : begin[i + 1]].tobytes() for ids, begin in buckets(batch.column(2)) for i in range(len(begin) - 1)]
            said = [x[0] if x[0] != languages.UNKNOWN else None for x in label(batch.column(2).to_pylist())] if label else [None] * len(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary()), pa.array(said, pa.string())], names=["doc_id", "label", "ids", "language"])

    rows = labelled(docs, labels, "toxic", 5, 0, sample, most).select("doc_id", "label", "text").mapInArrow(tidy(run), "doc_id long, label int, ids binary, language string").toArrow().sort_by("doc_id")
    ids, y, said = [np.frombuffer(x, np.int32).reshape(-1, 2) for x in rows.column("ids").to_pylist()], rows.column("label").to_numpy().astype(np.int64), rows.column("language").to_pylist()
    models = [train(ids, y, said, seed) for seed in range(1, NETS + 1)]
    for m in models[1:]:
        m.weights = models[0].weights  # the same table
    return models


def score(docs: DataFrame, models: list[Model], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, group (of languages; ``other`` for none). Null texts
    count as empty, which score as a text without words. Repeated rows give repeated results; other columns are
    ignored; a null id is not held out."""
    held = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = held.value
        names = ["other", *models[0].languages]
        for batch in batches:
            z, g = [], []
            for ids, begin in buckets(batch.column(1)):
                for whole, part in zip((z, g), mean_response(models, ids, begin), strict=True):
                    whole.append(part)
            z, g = np.concatenate(z) if z else np.zeros(0), np.concatenate(g) if g else np.zeros(0, np.int64)
            p = _logistic(z)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array([names[i] for i in g], pa.string())], names=[key, "score", "predicted", "group"])

    found = docs.select(F.col(key).cast("long").alias(key), F.col(text)).mapInArrow(tidy(run), f"{key} long, score double, predicted int, group string")
    return found.select(key, F.coalesce(fold(key, 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "group")
