"""Gettext catalogs: a parser for ``.po`` and ``.pot`` files, and the universe of their keys."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfathom.operators.liveness import universe

_LINE = re.compile(r'(msgctxt|msgid_plural|msgid|msgstr(?:\[\d+\])?)\s+"(.*)"\s*\Z|"(.*)"\s*\Z')
_ESCAPE = re.compile(r"\\([0-7]{1,3}|x[0-9A-Fa-f]{1,2}|.)", re.S)
#: C escapes (fixed values).
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}


class CatalogError(ValueError):
    """A catalog can't be used; the message names its file."""


@dataclass
class Entry:
    parts: dict[str, str] = field(default_factory=dict)
    fuzzy: bool = False


def _unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        e = m[1]
        if e[0] == "x" and len(e) > 1:
            return chr(int(e[1:], 16))
        return chr(int(e, 8) & 0xFF) if e[0] in "01234567" else _ESCAPES.get(e, e)

    return _ESCAPE.sub(one, text)


def entries(text: str) -> Iterator[Entry]:
    """Messages in order. Obsolete ones (``#~``) are comments. An entry ends where a new msgctxt or msgid begins."""
    now, field_, fuzzy = Entry(), "", False
    for number, raw in enumerate(text.removeprefix("﻿").splitlines(), 1):
        line = raw.strip()
        if not line:
            continue
        if line.startswith("#"):
            if line.startswith("#,") and "fuzzy" in [x.strip() for x in line[2:].split(",")]:
                fuzzy = True
            continue
        m = _LINE.match(line)
        if not m or not m[1] and not field_:
            raise CatalogError(f"line {number}: not a message line")
        if not m[1]:
            now.parts[field_] += _unescape(m[3])
            continue
        starts = m[1] == "msgctxt" and now.parts or m[1] == "msgid" and "msgid" in now.parts
        if starts:
            yield now
            now = Entry()
        if m[1] in ("msgctxt", "msgid") and not now.parts:
            now.fuzzy, fuzzy = fuzzy, False
        if m[1] in now.parts:
            raise CatalogError(f"line {number}: {m[1]} occurs twice")
        field_ = m[1]
        now.parts[field_] = _unescape(m[2])
    if now.parts:
        yield now


def parse(text: str) -> list[tuple[str | None, str, str | None]]:
    """(msgctxt, msgid, msgid_plural) of the messages that are not fuzzy. The header must come first and name a content
    type; a message without msgid or msgstr is an error."""
    found, header = [], False
    for e in entries(text):
        if "msgid" not in e.parts or not any(k.startswith("msgstr") for k in e.parts):
            raise CatalogError("a message lacks its msgid or msgstr")
        if e.parts["msgid"] == "" and "msgctxt" not in e.parts:
            header = header or "content-type:" in e.parts.get("msgstr", "").lower()
            continue
        if not header:
            break
        if not e.fuzzy:
            found.append((e.parts.get("msgctxt"), e.parts["msgid"], e.parts.get("msgid_plural")))
    if not header:
        raise CatalogError("the header with its Content-Type is missing")
    return found


def parsed(files: DataFrame) -> DataFrame:
    """(path, msgctxt, msgid, msgid_plural, error) from files (path, content binary); a bad file is one row with error."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    if content is None:
                        raise CatalogError("the file can't be read")
                    rows += [(path, *key, None) for key in parse(content.decode("utf-8"))]
                except Exception as e:  # noqa: BLE001  whatever one catalog does is that catalog's error
                    rows.append((path, None, None, None, str(e) if isinstance(e, CatalogError) else f"{type(e).__name__}: {e}"))
            names = ["path", "msgctxt", "msgid", "msgid_plural", "error"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(5)], names=names)

    return files.select("path", "content").mapInArrow(run, "path string, msgctxt string, msgid string, msgid_plural string, error string")


def load(files: DataFrame) -> DataFrame:
    """The universe of all catalogs, cached. No file and any bad file are errors; the first bad one by path is named."""
    if files.isEmpty():
        raise CatalogError("no catalog matches the configured patterns")
    rows = parsed(files).persist()
    bad = rows.where(F.col("error").isNotNull()).orderBy("path").select("path", "error").first()
    if bad:
        rows.unpersist()
        raise CatalogError(f"{bad.path}: {bad.error}")
    keys = universe(rows).persist()
    keys.count()
    rows.unpersist()
    return keys


def contains_msgid(keys: DataFrame, msgid: str) -> bool:
    """Whether any key has this text as its msgid or plural."""
    return not keys.where((F.col("msgid") == msgid) | (F.col("msgid_plural") == msgid)).isEmpty()
