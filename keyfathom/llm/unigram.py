"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

The vocabulary is read from a model file with its scores. A byte-pair model has merge ranks instead of log scores; the
caller says so, and they become the log probabilities of Zipf's law, log 1 / (rank + 1) less the log of the sum. White space is marked by U+2581, a character outside the vocabulary falls back to byte
pieces, and so does a U+2581 of the text itself, which makes decoding exact for every text."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfathom.llm.workers import tidy

MARK = "▁"
MARK_BYTES = MARK.encode()
#: Stands for a U+2581 of the text: no UTF-8 byte, so no piece holds it.
OWN_MARK = 0xFF
CACHE = 40_000
UNKNOWN = 10.0
#: Bytes of new units that are segmented at once.
STRETCH = 40_000


@dataclass
class Vocabulary:
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray  # piece id at a node, or -1
    score: np.ndarray  # by piece id
    surface: list[bytes]  # by piece id, as decoded
    byte_ids: np.ndarray
    fallback: float  # score of a byte of an unknown character
    longest: int
    unit: str  # a pattern of text that no piece reaches across


def double_array(pieces: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of a trie; the child of s by byte c is base[s] + c if check there is s. The root is 1."""
    tree: dict = {}
    for raw, i in pieces:
        node = tree
        for c in raw:
            node = node.setdefault(c, {})
        node[-1] = i
    size = 1 << 18
    base, check, value = [0] * size, [0] * size, [-1] * size
    check[0] = check[1] = -1
    start, wide, queue = 258, 258, [(1, tree)]  # so that no base is below 2
    for state, node in queue:
        value[state] = node.get(-1, -1)
        children = sorted(c for c in node if c >= 0)
        if not children:
            continue
        while check[start]:
            start += 1
        # several children look on from where the last such node was placed, one child takes the first free cell
        at = (max(wide, start) if len(children) > 1 else start) - children[0]
        while True:
            if at + 512 > len(base):
                grow = len(base)
                base += [0] * grow
                check += [0] * grow
                value += [-1] * grow
            if not any(check[at + c] for c in children):
                break
            at += 1
        if len(children) > 1:
            wide = at + children[0]
        base[state] = at
        for c in children:
            check[at + c] = state
        queue += [(at + c, node[c]) for c in children]
    return np.array(base, np.int32), np.array(check, np.int32), np.array(value, np.int32)


def vocabulary(pieces: list[str], scores: list[float], kinds: list[str], ranks: bool = False) -> Vocabulary:
    """From pieces, scores and kinds: ``normal``, ``byte`` (``<0xNN>``, all 256), or others that are never produced.

    With ``ranks`` the scores are merge ranks, 0 or less; without it they are log scores and taken as they are."""
    normal = [i for i, k in enumerate(kinds) if k == "normal"]
    score = np.array(scores, float)
    if ranks and len(normal):
        place = -score[normal]
        if (place < 0).any():
            raise ValueError("merge ranks are 0 or less")
        score[normal] = -np.log(place + 1) - np.log(np.sum(1 / (place + 1)))  # some pieces have a rank far beyond the others'
    byte_ids = np.full(256, -1)
    surface = [b""] * len(pieces)
    for i, k in enumerate(kinds):
        if k == "byte":
            byte_ids[int(pieces[i][3:5], 16)] = i
            surface[i] = bytes([int(pieces[i][3:5], 16)])
        elif k == "normal":
            surface[i] = pieces[i].replace(MARK, " ").encode()
    if (byte_ids < 0).any():
        raise ValueError("the vocabulary has no full set of byte pieces")
    base, check, value = double_array([(pieces[i].encode(), i) for i in normal])
    inner = any(MARK in pieces[i].lstrip(MARK) for i in normal)
    line = any("\n" in pieces[i] for i in normal)
    unit = r"(?s:.+)" if inner else (r" *[^ ]+| +" if line else r"\n| *[^ \n]+| +")
    longest = max((len(pieces[i].encode()) for i in normal), default=1)
    return Vocabulary(base, check, value, score.astype(np.float64), surface, byte_ids, float(score[normal].min() if len(normal) else 0) - UNKNOWN, longest, unit)


def load(path: str, ranks: bool = False) -> Vocabulary:
    """Read a SentencePiece model file on the driver. ``ranks`` says that its scores are merge ranks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    kinds = ["byte" if model.is_byte(i) else "other" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "normal" for i in ids]
    return vocabulary([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], kinds, ranks)


def _marked(unit: str) -> bytes:
    return unit.encode("utf-8", "surrogatepass").replace(MARK_BYTES, bytes([OWN_MARK])).replace(b" ", MARK_BYTES)


def segment(vocab: Vocabulary, units: list[str]) -> list[array]:
    """The ids of the best segmentation of each unit. Of equal ones, the one whose last pieces are longer."""
    raw = [_marked(u) for u in units]
    lengths = np.array([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32)
    ends = np.cumsum(lengths)
    first = ends - lengths
    owner = np.repeat(np.arange(len(raw)), lengths)
    head = np.flatnonzero((data & 0xC0) != 0x80)
    sources, targets, pieces, gains = [], [], [], []
    at, state = head, np.ones(len(head), np.int32)
    single = np.zeros(len(data), bool)
    size = np.diff(np.append(head, len(data)))
    for l in range(vocab.longest):  # noqa: E741
        inside = at + l < ends[owner[at]]
        at, state = at[inside], state[inside]
        down = vocab.base[state] + data[at + l]
        good = vocab.check[down] == state
        at, state = at[good], down[good]
        if not len(at):
            break
        found = vocab.value[state]
        hit = found >= 0
        sources.append(at[hit])
        targets.append(at[hit] + l + 1)
        pieces.append(found[hit])
        gains.append(vocab.score[found[hit]])
    reach = np.zeros(len(data) + 1, np.int64)
    reach[head] = head + size
    for s, t in zip(sources, targets, strict=True):
        single[s[t == reach[s]]] = True
    lone = head[~single[head]]
    sources.append(lone)
    targets.append(reach[lone])
    pieces.append(np.full(len(lone), -1, np.int32))
    gains.append(vocab.fallback * (reach[lone] - lone))
    source, target, piece, gain = (np.concatenate(x) for x in (sources, targets, pieces, gains))
    # ends of units get places of their own: byte p of unit u is node p + u
    shift = owner[source]
    source, target = source + shift, target + shift
    order = np.argsort(source - (first + np.arange(len(raw)))[shift], kind="stable")
    source, target, piece, gain = source[order], target[order], piece[order], gain[order]
    step = source - (first + np.arange(len(raw)))[shift[order]]
    best = np.full(len(data) + len(raw), -np.inf)
    best[first + np.arange(len(raw))] = 0
    back = np.zeros(len(best), np.int64)
    by = np.zeros(len(best), np.int64)
    cuts = np.flatnonzero(np.diff(step)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(step)], strict=True):
        s, t = source[a:b], target[a:b]
        value = best[s] + gain[a:b]
        better = value > best[t]
        t = t[better]
        best[t], back[t], by[t] = value[better], s[better], piece[a:b][better]
    back_list, by_list = back.tolist(), by.tolist()
    byte_ids = vocab.byte_ids.tolist()
    out = []
    for u, (a, b) in enumerate(zip((first + np.arange(len(raw))).tolist(), (ends + np.arange(len(raw))).tolist(), strict=True)):
        ids = []
        while b > a:
            i = by_list[b]
            if i >= 0:
                ids.append(i)
            else:
                own = raw[u][back_list[b] - a : b - a]
                ids += [byte_ids[c] for c in reversed(MARK_BYTES if own == bytes([OWN_MARK]) else own)]
            b = back_list[b]
        out.append(array("i", reversed(ids)))
    return out


class Tokenizer:
    """Encodes and decodes; the segmentations of units seen before are kept, up to CACHE.

    Texts that wait for new units are held as unit numbers, which are a tenth of the size of the units."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.unit = re.compile(vocab.unit)
        self.number: dict[str, int] = {}
        self.known: list[array] = []

    def encode_batch(self, texts: list[str | None]) -> Iterator[array]:
        held: list[array] = []
        new: list[str] = []
        size = 0
        for text in texts:
            number, units = self.number, array("i")
            for m in self.unit.finditer(" " + text) if text else ():
                u = m[0]
                i = number.get(u)
                if i is None:
                    i = number[u] = len(number)
                    new.append(u)
                    size += len(u)
                units.append(i)
            held.append(units)
            if size > STRETCH:
                yield from self._finish(held, new)
                held, new, size = [], [], 0
        yield from self._finish(held, new)

    def _finish(self, held: list[array], new: list[str]) -> Iterator[array]:
        if new:
            self.known += segment(self.vocab, new)
        known = self.known
        for units in held:
            ids = array("i")
            for u in units:
                ids += known[u]
            yield ids
        if len(known) > CACHE:
            self.number, self.known = {}, []

    def encode(self, text: str) -> list[int]:
        return next(self.encode_batch([text])).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        surface = self.vocab.surface
        raw = b"".join([surface[i] for i in ids])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, vocab: Vocabulary, key: str = "doc_id", text: str = "text", tokens: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, n_byte_tokens, ids_sha256, decoded_sha256, round_trip, tokens.

    ``ids_sha256`` is over little-endian 32-bit ids, ``decoded_sha256`` over the UTF-8 of what decoding gives, and
    ``round_trip`` says that it equals the text. Null and empty texts have no tokens. Repeated rows give repeated
    results; other columns are ignored."""
    held = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(held.value)
        fallback = np.zeros(len(held.value.surface), bool)
        fallback[held.value.byte_ids] = True
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out, flat, ends = [], array("i"), [0]
            for value, ids in zip(texts, tokenizer.encode_batch(texts), strict=True):
                body, back = value or "", tokenizer.decode(ids)
                view = np.frombuffer(ids, np.int32)
                out.append((len(body.encode()), len(ids), int(fallback[view].sum()), hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == body))
                if tokens:
                    flat += ids
                    ends.append(len(flat))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
            names = ["n_bytes", "n_tokens", "n_byte_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
            columns = [batch.column(0), *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds))]
            if tokens:
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if len(flat) else [], pa.int32())))
                names.append("tokens")
            yield pa.RecordBatch.from_arrays(columns, names=[key, *names])

    schema = f"{key} long, n_bytes long, n_tokens long, n_byte_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", tokens array<int>" * tokens
    return docs.select(F.col(key).cast("long").alias(key), F.col(text)).mapInArrow(tidy(run), schema)


def decode_documents(df: DataFrame, vocab: Vocabulary, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(doc_id, text) from token ids; null tokens give a null text."""
    held = df.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(held.value)
        for batch in batches:
            texts = [None if ids is None else tokenizer.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(F.col(key).cast("long").alias(key), F.col(tokens)).mapInArrow(tidy(run), f"{key} long, text string")
