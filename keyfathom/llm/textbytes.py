"""Texts of an Arrow column as one numpy byte array, and word hashes over it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII but letters and digits.
NO_WORD = np.zeros(256, bool)
NO_WORD[:128] = [not chr(c).isalnum() for c in range(128)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Powers that a worker keeps, and bytes of words that are hashed at once; a longer word is hashed on its own.
KEPT = 1 << 20
_kept: dict[int, np.ndarray] = {}


def powers(factor: int, n: int) -> np.ndarray:
    """factor**i modulo 2**64 for i < n."""
    have = _kept.get(factor)
    if have is None or len(have) < n:
        have = np.full(1 << max(n - 1, 1).bit_length(), factor, np.uint64)
        have[0] = 1
        np.cumprod(have, dtype=np.uint64, out=have)
        if len(have) <= KEPT:
            _kept[factor] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and len + 1 offsets into them; a null is an empty text."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes; a longer text is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE, longest: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of some texts, and where each text's words begin (len + 1).

    Words are runs of other bytes than ``breaks``, white space by default; A-Z count as a-z.
    With ``longest``, a hash is over that many bytes of its word at most."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = np.zeros(n + 1, bool)
    solid[:n] = ~breaks[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:]
    ends = np.zeros(n + 1, bool)
    ends[1:] = solid[:-1] & (~solid[1:] | edge[1:])
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    stop = np.minimum(end, start + longest) if longest else end
    value = np.zeros(len(start), np.uint64)
    i = 0
    while i < len(start):
        at = int(start[i])
        j = max(i + 1, int(np.searchsorted(stop, at + KEPT // 2, side="right")))
        m = int(stop[j - 1]) - at
        total = np.zeros(m + 1, np.uint64)
        np.cumsum((LOWER[data[at : at + m]].astype(np.uint64) + np.uint64(1)) * powers(BASE, m), out=total[1:])
        x, y = start[i:j] - at, stop[i:j] - at
        value[i:j] = (total[y] - total[x]) * powers(INVERSE, m + 1)[x]
        i = j
    value = mix(value + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return start, end, value, np.searchsorted(start, offsets)


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
