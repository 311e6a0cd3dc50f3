"""String tokens of the scanned languages: unescaping, interpolation, segments and guards."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Escapes that PHP double-quoted and JavaScript strings share (fixed values); ``e`` is PHP's alone.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"', "'": "'", "`": "`", "$": "$", "0": "\0", "v": "\v", "f": "\f", "b": "\b"}
PHP_ESCAPES = ESCAPES | {"e": "\x1b"}
_PAIR = re.compile(r"\\(.)", re.S)
_PHP_SINGLE = re.compile(r"\\([\\'])")
_TWIG = re.compile(r"\\([\\'\"])")

#: A static fragment is its text; a hole is None.
Segments = list[str | None]


def unescape_php_single(inner: str) -> str:
    return _PHP_SINGLE.sub(r"\1", inner)


def unescape_php_double(inner: str) -> str:
    """Unknown escapes keep their backslash."""
    return _PAIR.sub(lambda m: PHP_ESCAPES.get(m[1], m[0]), inner)


def unescape_js(inner: str) -> str:
    """Unknown escapes lose their backslash."""
    return _PAIR.sub(lambda m: ESCAPES.get(m[1], m[1]), inner)


def unescape_twig(inner: str) -> str:
    return _TWIG.sub(r"\1", inner)


def _unescaped(inner: str, mark: str) -> bool:
    return mark in _PAIR.sub("", inner)


def decode_token(lang: str, token: str) -> str | None:
    """The value of a quoted token of ``php``, ``js`` or ``twig``; None if it is dynamic, empty if it is unquoted."""
    if len(token) < 2 or token[0] not in "'\"`":
        return ""
    quote, inner = token[0], token[1:-1]
    if lang == "php":
        if quote != '"':
            return unescape_php_single(inner)
        return None if _unescaped(inner, "$") else unescape_php_double(inner)
    if lang == "js":
        return None if quote == "`" and _unescaped(inner, "${") else unescape_js(inner)
    return None if quote == '"' and "#{" in inner else unescape_twig(inner)


def guards(segments: Segments, min_len: int) -> list[tuple[str, str]]:
    """(kind, fragment) of the static segments that are long enough, by their place: first prefix, last suffix, other
    or only one contains. Neighbouring static segments stay apart."""
    last = len(segments) - 1
    place = lambda i: "contains" if last == 0 or 0 < i < last else "prefix" if i == 0 else "suffix"
    return [(place(i), s) for i, s in enumerate(segments) if s is not None and len(s) >= min_len]


#: Placeholders (fixed pattern): ``%(name)s``, printf with position, flags, width and precision, and braces.
PLACEHOLDER = r"%\([^)]+\)[a-zA-Z]|%(?:\d+\$)?[-+ 0#']*\d*(?:\.\d+)?[a-zA-Z]|\{[^}]*\}"


def skeleton_fragments(key: Column, min_len: int) -> Column:
    """Static parts of a key around its placeholders that are long enough; none for a key without a placeholder."""
    parts = F.filter(F.split(key, PLACEHOLDER, -1), lambda x: F.char_length(x) >= min_len)
    return F.when(key.rlike(PLACEHOLDER), parts).otherwise(F.array().cast("array<string>"))


def php_single(inner: Column) -> Column:
    return F.regexp_replace(inner, r"\\([\\'])", "$1")


def guards_of(segments: Column, min_len: int) -> Column:
    """The relational form of ``guards`` over array<struct<is_hole, text>>."""
    last = F.size(segments) - 1
    kind = lambda i: F.when((last == 0) | ((i > 0) & (i < last)), "contains").when(i == 0, "prefix").otherwise("suffix")
    placed = F.transform(segments, lambda s, i: F.struct(kind(i).alias("kind"), s["text"].alias("frag"), s["is_hole"].alias("hole")))
    kept = F.filter(placed, lambda g: ~g["hole"] & (F.char_length(g["frag"]) >= min_len))
    return F.transform(kept, lambda g: F.struct(g["kind"].alias("kind"), g["frag"].alias("frag")))
