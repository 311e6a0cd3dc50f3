"""Media columns: Netpbm and BMP images as numpy arrays, area-resized by integral images, as NPY tiles with
difference hashes."""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfathom.llm.workers import tidy

STRIP = 4096


class MediaError(ValueError):
    """Bytes that are no image of a known form."""


def _header(raw: bytes, n: int) -> tuple[list[int], int]:
    """n decimal numbers after the magic and where the samples begin; ``#`` comments run to the end of the line."""
    found: list[int] = []
    at = 2
    while len(found) < n:
        while at < len(raw) and raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            line = raw.find(b"\n", at)
            at = len(raw) if line < 0 else line + 1
            continue
        stop = at
        while stop < len(raw) and 48 <= raw[stop] <= 57:
            stop += 1
        if stop == at:
            raise MediaError("a number is missing in the header")
        found.append(int(raw[at:stop]))
        at = stop
    return found, at + 1


def decode_netpbm(raw: bytes) -> np.ndarray:
    """P1 to P6 as (height, width) or (height, width, 3); bitmaps as 0 and 1, 16-bit samples as uint16."""
    kind = raw[:2]
    if len(kind) < 2 or kind[0:1] != b"P" or kind[1:2] not in b"123456":
        raise MediaError("not a Netpbm image")
    number = int(kind[1:2])
    bitmap, plain, depth = number in (1, 4), number < 4, 3 if number in (3, 6) else 1
    (width, height, *rest), at = _header(raw, 2 if bitmap else 3)
    top = rest[0] if rest else 1
    if not 0 < top < 65536:
        raise MediaError("the largest sample value is out of range")
    shape = (height, width) if depth == 1 else (height, width, 3)
    n = height * width * depth
    kind = np.dtype(np.uint8 if top < 256 else np.uint16)
    if plain:
        body = b"\n".join(line.split(b"#")[0] for line in raw[at - 1 :].split(b"\n"))
        values = [c - 48 for c in body if 48 <= c <= 49] if bitmap else [int(x) for x in body.split()]
        if len(values) < n:
            raise MediaError("samples are missing")
        return np.array(values[:n], kind).reshape(shape)
    if bitmap:
        row = -(-width // 8)
        if len(raw) - at < row * height:
            raise MediaError("samples are missing")
        bits = np.frombuffer(raw, np.uint8, row * height, at).reshape(height, row)
        return np.unpackbits(bits, axis=1)[:, :width]
    if len(raw) - at < n * kind.itemsize:
        raise MediaError("samples are missing")
    return np.frombuffer(raw, kind.newbyteorder(">"), n, at).astype(kind, copy=False).reshape(shape)


def decode_bmp(raw: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits as (height, width, 3) red, green, blue."""
    if raw[:2] != b"BM" or len(raw) < 54:
        raise MediaError("not a BMP image")
    u4 = lambda at: int.from_bytes(raw[at : at + 4], "little", signed=True)
    begin, head, width, height = u4(10), u4(14), u4(18), u4(22)
    bits, packing, used = int.from_bytes(raw[28:30], "little"), u4(30), u4(46)
    if packing != 0 or bits not in (1, 4, 8, 24, 32) or width <= 0 or height == 0:
        raise MediaError("this form of BMP is not supported")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    if len(raw) < begin + rows * stride:
        raise MediaError("samples are missing")
    body = np.frombuffer(raw, np.uint8, rows * stride, begin).reshape(rows, stride)
    if height > 0:
        body = body[::-1]
    if bits >= 24:
        step = bits // 8
        return body[:, : width * step].reshape(rows, width, step)[:, :, 2::-1].copy()
    colours = np.frombuffer(raw, np.uint8, 4 * (used or 1 << bits), 14 + head).reshape(-1, 4)[:, 2::-1]
    if bits == 8:
        index = body[:, :width]
    else:
        cells = np.unpackbits(body, axis=1).reshape(rows, -1, bits)
        index = cells @ (1 << np.arange(bits - 1, -1, -1))
        index = index[:, :width]
    return colours[index]


def decode(raw: bytes) -> np.ndarray:
    """An image of either family; other bytes raise MediaError."""
    return decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)


def encode_pgm(samples: np.ndarray) -> bytes:
    """Binary PGM of 8-bit samples (height, width)."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.tobytes()


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def _integral_at(image: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Rows ``ys`` of the integral image (rows 0 to height, columns 0 to width), built strip by strip."""
    height, width = image.shape
    out = np.zeros((len(ys), width + 1))
    above = np.zeros(width + 1)
    for top in range(0, height, STRIP):
        strip = image[top : top + STRIP]
        table = np.zeros((len(strip) + 1, width + 1))
        np.cumsum(np.cumsum(strip, axis=0, dtype=np.float64), axis=1, out=table[1:, 1:])
        table += above
        here = (ys > top) & (ys <= top + len(strip))
        out[here] = table[ys[here] - top]
        above = table[-1]
    return out


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean over each target cell's area, cells cut at fractions of pixels; float64 (height, width)."""
    image = grey(image)
    rows, columns = image.shape
    y, x = np.arange(height + 1) * (rows / height), np.arange(width + 1) * (columns / width)
    low, high = np.floor(y).astype(np.int64), np.minimum(np.ceil(y).astype(np.int64), rows)
    low, part = np.minimum(low, rows), (y - low)[:, None]
    table = _integral_at(image, low) * (1 - part) + _integral_at(image, high) * part
    low, high = np.floor(x).astype(np.int64), np.minimum(np.ceil(x).astype(np.int64), columns)
    low, part = np.minimum(low, columns), x - low
    table = table[:, low] * (1 - part) + table[:, high] * part
    sums = table[1:, 1:] - table[:-1, 1:] - table[1:, :-1] + table[:-1, :-1]
    return sums / (rows / height * columns / width)


def difference_hash(image: np.ndarray) -> str:
    """64 bits as 16 hex digits: over an 8 x 9 area-resized image, whether a cell is darker than its right one."""
    small = area_resize(image, 8, 9).round(6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def media_tiles(df: DataFrame, column: str, height: int = 16, width: int = 16) -> DataFrame:
    """One row per media value: the columns of ``df`` but ``column``, with width, height, NPY tile and hash.

    A null or undecodable value gives nulls and its ``media_error``. Columns of ``df`` that clash with the new ones
    are replaced."""
    new = [("media_height", pa.int32()), ("media_width", pa.int32()), ("tile", pa.binary()), ("dhash", pa.string()), ("media_error", pa.string())]
    names = {n for n, _ in new}
    keep = [c for c in df.columns if c != column and c not in names]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for raw in batch.column(len(keep)):
                try:
                    if not raw.is_valid:
                        raise MediaError("null")
                    image = decode(raw.as_py())
                    if 0 in image.shape:
                        raise MediaError("empty image")
                    tile = area_resize(image, height, width).round().astype(np.uint16 if image.dtype == np.uint16 else np.uint8)
                    rows.append((*image.shape[:2], npy(tile), difference_hash(image), None))
                except (MediaError, IndexError, ValueError) as e:
                    rows.append((None, None, None, None, str(e)))
            arrays = [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(new)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *arrays], names=[*keep, *(n for n, _ in new)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(keep).schema), "media_height int, media_width int, tile binary, dhash string, media_error string"])
    return df.select(*keep, F.col(column).cast("binary")).mapInArrow(tidy(run), schema)


def text_media(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 64) -> DataFrame:
    """Store each whole text as a PGM image of ``width`` columns, read it back, and compute features of what was read.

    Null and empty texts store one row of zeros. Equal texts give equal values; there is one output row per input row.
    ``tile`` is the NPY tile of the area-resized image."""
    schema = f"{key} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for value in batch.column(1):
                raw = value.as_py() or b""
                full = max(width, -(-len(raw) // width) * width)
                stored = encode_pgm(np.frombuffer(raw.ljust(full, b"\0"), np.uint8).reshape(-1, width))
                image = decode(stored)
                back = image.tobytes()
                tile = area_resize(image, 16, 16).round().astype(np.uint8)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(image), npy(tile)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"]
            arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[key, *names])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("binary")).mapInArrow(tidy(run), schema)
