"""Language ID: script ranges narrow the candidates, then Viterbi over per-word scores with a switching penalty.

A word's score for a language is a naive Bayes log likelihood over its character n-grams, learned from a bounded sample
of labelled texts. A language is a candidate for a word if the sample has it in the word's script."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfathom.llm.samples import by_hash, fold, within
from keyfathom.llm.textbytes import mix
from keyfathom.llm.workers import tidy

#: First code points of Unicode script ranges (fixed values), each up to the next one.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0780, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Other"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Other"), (0x0E00, "Thai"), (0x0E80, "Other"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Hiragana"), (0x30A0, "Katakana"),
    (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xA720, "Latin"), (0xA800, "Other"),
    (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Other"),
    (0x20000, "Han"), (0x323B0, "Other"),
]
_FIRST = np.array([c for c, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_INDEX = np.array([_NAMES.index(n) for _, n in SCRIPTS])

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
PENALTY = 8.0
UNKNOWN = "und"
#: Training rows, and bytes of their texts.
SAMPLE = 3000
SAMPLE_BYTES = 32 << 20
CACHE = 60_000
CHUNK_WORDS = 200_000
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    languages: list[str]
    prior: int
    weights: np.ndarray  # (BUCKETS, languages): centred log likelihoods
    allowed: np.ndarray  # (scripts, languages)
    spans: bool = field(default=False)


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word index and bucket of each character n-gram of ``<word>``, and each word's script."""
    text = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), lengths)
    first = np.cumsum(lengths) - lengths
    script = _INDEX[np.searchsorted(_FIRST, codes[first + 1].astype(np.int64), side="right") - 1]
    whose, bucket = [], []
    rolled = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        rolled = rolled[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        inside = owner[: len(rolled)] == owner[n - 1 :]
        if n in ORDERS:
            whose.append(owner[: len(rolled)][inside])
            bucket.append((mix(rolled[inside] + np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & np.uint64(BUCKETS - 1)).astype(np.int64))
    return np.concatenate(whose), np.concatenate(bucket), script


def _plain(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def fit(rows: Iterable[tuple[str, str]]) -> Model:
    """A model from (text, language) rows; without rows there are no languages."""
    seen: dict[str, Counter] = {}
    docs: Counter = Counter()
    for text, language in rows:
        docs[language] += 1
        seen.setdefault(language, Counter()).update(filter(None, map(_plain, WORD.findall(text.lower()))))
    languages = sorted(seen)
    counts = np.full((BUCKETS, len(languages)), 0.1)
    allowed = np.zeros((len(_NAMES), len(languages)), bool)
    for k, language in enumerate(languages):
        if not seen[language]:
            continue
        words, n = zip(*seen[language].items(), strict=True)
        n = np.array(n, float)
        owner, bucket, script = _grams(list(words))
        # a word's weight grows slowly with its count, so that a repeated one doesn't drown the rest
        np.add.at(counts[:, k], bucket, np.sqrt(n)[owner])
        share = np.bincount(script, n, minlength=len(_NAMES)) / n.sum()
        allowed[:, k] = share >= 0.01
    weights = np.log(counts / counts.sum(axis=0, keepdims=True)) if languages else counts
    if languages:
        weights -= weights.mean(axis=1, keepdims=True)
    return Model(languages, languages.index(max(languages, key=lambda x: docs[x])) if languages else 0, weights.astype(np.float32), allowed)


def word_scores(model: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Scores (words, languages), with a very low one for languages outside the word's script, and which words count."""
    n = len(model.languages)
    if not n:
        return np.zeros((len(words), 0), np.float32), np.zeros(len(words), bool)
    owner, bucket, script = _grams(words)
    score = np.stack([np.bincount(owner, model.weights[bucket, k], minlength=len(words)) for k in range(n)], axis=1)
    known = model.allowed[script]
    some = known.any(axis=1)
    score = np.where(known, 0.5 * score, -1e4)
    score[~some] = 0
    return score.astype(np.float32), some


def viterbi(scores: np.ndarray, offsets: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best label of each row of ``scores`` per text (offsets, len + 1), all texts in step."""
    n, k = scores.shape
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = offsets[:-1][order], lengths[order]
    steps = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(steps), side="left")  # texts longer than t
    came = np.empty((n, k), np.uint8 if k < 256 else np.uint16)
    own = np.arange(k, dtype=came.dtype)
    value = np.zeros((len(lengths), k), np.float32)
    for t in range(steps):
        m = int(alive[t])
        at = starts[:m] + t
        if t:
            v = value[:m]
            best = v.argmax(axis=1)
            jump = v[np.arange(m), best][:, None] - penalty
            stay = v >= jump
            came[at] = np.where(stay, own, best[:, None].astype(came.dtype))
            value[:m] = np.where(stay, v, jump) + scores[at]
        else:
            value[:m] = scores[at]
        value[:m] -= value[:m].max(axis=1, keepdims=True)
    label = np.empty(n, came.dtype)
    state = value.argmax(axis=1) if k else np.zeros(0, np.int64)
    for t in range(steps - 1, -1, -1):
        m = int(alive[t])
        at = starts[:m] + t
        label[at] = state[:m]
        if t:
            state[:m] = came[at, state[:m]]
    return label


class Labeller:
    """Labels texts; scores of words seen before are kept, up to CACHE words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.ids: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)), np.float32)
        self.counted = np.zeros(0, bool)
        self.letters = np.zeros(0, np.int64)

    def _learn(self, new: dict[str, int]) -> None:
        plain = [_plain(w) for w in new]
        filled = [p or "a" for p in plain]
        score, some = word_scores(self.model, filled)
        letters = np.array([len(p) for p in plain])
        some &= letters > 0
        score[~some] = 0
        self.scores = np.concatenate((self.scores, score))
        self.counted = np.concatenate((self.counted, some))
        self.letters = np.concatenate((self.letters, letters))

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
        """Per text the language, the share of letters in its words, and the spans if the model asks for them."""
        at = 0
        while at < len(texts):
            if len(self.ids) > CACHE:
                self.__init__(self.model)
            first, n, flat, ends, new = at, 0, [], [0], {}
            known, size = self.ids, len(self.ids)
            while at < len(texts) and n < CHUNK_WORDS:
                words = WORD.findall((texts[at] or "").lower())
                for w in words:
                    i = known.get(w)
                    if i is None:
                        i = known[w] = size
                        size += 1
                        new[w] = i
                    flat.append(i)
                n += len(words)
                ends.append(n)
                at += 1
            if new:
                self._learn(new)
            yield from self._label(texts[first:at], np.array(flat, np.int64), np.array(ends))

    def _label(self, texts: list[str | None], flat: np.ndarray, ends: np.ndarray) -> Iterator[tuple[str, float, list[tuple[int, int, str]], float]]:
        k = len(self.model.languages)
        letters, counted = self.letters[flat], self.counted[flat]
        label = viterbi(self.scores[flat], ends) if k else np.zeros(len(flat), np.uint8)
        doc = np.repeat(np.arange(len(texts)), np.diff(ends))
        total = np.bincount(doc, letters, minlength=len(texts))
        by = np.bincount(doc * max(k, 1) + label, letters * counted, minlength=len(texts) * max(k, 1)).reshape(len(texts), -1)
        for i, text in enumerate(texts):
            if not total[i] or not k:
                yield UNKNOWN, 0.0, [], float(total[i] > 0)
                continue
            best = int(by[i].argmax()) if by[i].any() else self.model.prior
            yield self.model.languages[best], float(by[i, best] / total[i]), self._spans(text, label[ends[i] : ends[i + 1]]) if self.model.spans else [], float(by[i].sum() / total[i])

    def _spans(self, text: str, label: np.ndarray) -> list[tuple[int, int, str]]:
        found = list(WORD.finditer(text if len(text.lower()) != len(text) else text.lower()))
        if len(found) != len(label):  # lower-casing moved a word's edge
            found = list(WORD.finditer(text.lower()))
        cuts = [0, *(np.flatnonzero(np.diff(label.astype(np.int64))) + 1).tolist(), len(label)]
        return [(found[a].start(), found[b - 1].end(), self.model.languages[label[a]]) for a, b in zip(cuts, cuts[1:], strict=False)]


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> Model:
    """Fit on about ``sample`` rows outside the held-out fold with a language, of at most ``most`` bytes in all.

    Null texts and languages and, as they have no fold, null ids are left out; repeated rows count as often as they
    occur. Without rows the model has no languages."""
    rows = docs.where(F.col(language).isNotNull() & F.col(text).isNotNull() & (fold(key, 4) != 2)).select(key, text, language)
    rows = within(by_hash(rows, sample, key), most, key, text)
    return fit((r[0], r[1]) for r in rows.select(text, language).toLocalIterator())


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", spans: bool = False) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, and with ``spans`` the spans (start, end, lang) of the text.

    Null texts and texts without a letter are ``und`` with score 0. The score is the share of the letters that lie in
    words of that language; words in a script that no language has count for none. Ties go to the first language in
    order. Repeated rows give repeated results; other columns are ignored."""
    held = docs.sparkSession.sparkContext.broadcast(Model(model.languages, model.prior, model.weights, model.allowed, spans))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = Labeller(held.value)
        for batch in batches:
            out = list(label(batch.column(1).to_pylist()))
            columns = [batch.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())]
            names = [key, "lang_pred", "score"]
            if spans:
                columns.append(pa.array([[{"start": a, "end": b, "lang": c} for a, b, c in o[2]] for o in out], span))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"{key} long, lang_pred string, score double" + ", spans array<struct<start:int,end:int,lang:string>>" * spans
    return docs.select(F.col(key).cast("long").alias(key), F.col(text)).mapInArrow(tidy(run), schema)


def keep_identified(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, with at least this share of their letters in words of known languages, whether
    one or several. Where the model has no language, all rows with a letter stay."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = Labeller(held.value)
        for batch in batches:
            keep = [known > 0 and known >= least for *_, known in label(batch.column(place).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
