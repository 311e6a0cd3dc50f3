"""PHP: a lexer for scripts with embedded HTML, and the calls in their token streams."""

from __future__ import annotations

import re

from keyfathom.config import CallSpec
from keyfathom.functions.calls import Call, Facts, Task, Token, arguments, brackets, collect, split_top, trampoline
from keyfathom.functions.strings import Segments, unescape_php_double, unescape_php_single

_OPEN = re.compile(r"<\?(?:php\b|=)?", re.I)
_SPACE = re.compile(r"\s+")
_LINE = re.compile(r"(?://|\#(?!\[))(?:(?!\?>)[^\r\n])*")
_BLOCK = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_SINGLE = re.compile(r"[bB]?'(?:[^'\\]|\\.)*(?:'|\Z)", re.S)
_HERE = re.compile(r"[bB]?<<<[ \t]*(['\"]?)([A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)\1\r?\n")
_VAR = re.compile(r"\$+[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*")
_NAME = re.compile(r"\\?[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*(?:\\[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)*")
_NUMBER = re.compile(r"(?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?|\.\d+)")
_CAST = re.compile(r"\(\s*(?:int|integer|bool|boolean|float|double|string|array|object|unset|binary)\s*\)", re.I)
_OPS = sorted(["?->", "->", "::", "=>", "===", "!==", "==", "!=", "<>", "<=>", "<=", ">=", "&&", "||", "??=", "??", "...", "**=", "**", "++", "--", "<<=", ">>=", "<<", ">>", "+=", "-=", "*=", "/=", ".=", "%=", "&=", "|=", "^="], key=len, reverse=True)
_ESCAPE = re.compile(r"\\(?:[nrtvef\\$\"]|[0-7]{1,3}|x[0-9A-Fa-f]{1,2}|u\{[0-9A-Fa-f]+\})")
_SIMPLE = re.compile(r"\$[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*(?:\[[^\]\"]*\]|\??->[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)?")

#: Words before a parenthesis that make no function call (fixed values).
KEYWORDS = set(
    "if elseif else while for foreach switch match catch declare array list isset empty unset exit die eval echo print return "
    "include include_once require require_once function fn use and or xor not new clone throw yield static self parent".split()
)
#: Top-level operators that bind weaker than concatenation (fixed values).
LOOSE = set("? : ?? && || == != <> === !== < > <= >= <=> = += -= *= /= .= %= **= ??= &= |= ^= <<= >>= & | ^ => ;".split())
LOOSE_WORDS = {"and", "or", "xor", "instanceof", "print", "yield", "include", "include_once", "require", "require_once", "throw", "fn", "function", "match"}


class _Lexer:
    def __init__(self, text: str) -> None:
        self.text = text
        self.streams: list[list[Token]] = []
        self.strings: list[Segments] = []

    def file(self) -> None:
        at = 0
        while m := _OPEN.search(self.text, at):
            at = trampoline(self.code(m.end()))

    # Nesting is as deep as a file makes it, so each part is a task of ``trampoline``, not a call.

    def code(self, at: int, stop: str | None = None) -> Task[int]:
        """Tokens up to ``?>``, or up to an unmatched ``stop``; where the text goes on."""
        text, n = self.text, len(self.text)
        out: list[Token] = []
        self.streams.append(out)
        depth = 0
        while at < n:
            c = text[at]
            if stop is None and text.startswith("?>", at):
                return at + 2
            if m := _SPACE.match(text, at) or _LINE.match(text, at) or _BLOCK.match(text, at):
                at = m.end()
                continue
            if stop and c == stop and not depth:
                return at + 1
            if m := _SINGLE.match(text, at):
                raw = m[0]
                value = unescape_php_single(raw[1:-1]) if raw[0] == "'" and len(raw) > 1 else ""
                out.append(Token("string", raw, at, m.end(), [value]))
                self.strings.append([value])
                at = m.end()
            elif c == '"' or c in "bB" and text.startswith('"', at + 1):
                begin = at
                segments, at = yield self.quoted(at + (c != '"') + 1, '"')
                out.append(Token("string", text[begin:at], begin, at, segments))
                self.strings.append(segments)
            elif c == "`":
                begin = at
                _, at = yield self.quoted(at + 1, "`")
                out.append(Token("other", text[begin:at], begin, at))
            elif m := _HERE.match(text, at):
                end = re.compile(rf"^[ \t]*{re.escape(m[2])}\b", re.M).search(text, m.end())
                close = end.end() if end else n
                if m[1] != "'":
                    body = _Lexer(text[: end.start() if end else n])
                    body.streams, body.strings = self.streams, self.strings
                    yield body.quoted(m.end(), "")
                out.append(Token("other", text[at:close], at, close))
                at = close
            elif m := _VAR.match(text, at):
                out.append(Token("var", m[0], at, m.end()))
                at = m.end()
            elif m := _NAME.match(text, at):
                out.append(Token("name", m[0], at, m.end()))
                at = m.end()
            elif m := _NUMBER.match(text, at):
                out.append(Token("number", m[0], at, m.end()))
                at = m.end()
            elif c == "(" and (m := _CAST.match(text, at)):
                out.append(Token("op", "cast", at, m.end()))
                at = m.end()
            else:
                op = next((o for o in _OPS if text.startswith(o, at)), c)
                depth += (op in ("(", "[", "{")) - (op in (")", "]", "}"))
                out.append(Token("op", op, at, at + len(op)))
                at += len(op)
        return n

    def quoted(self, at: int, quote: str) -> Task[tuple[Segments, int]]:
        """Segments of an interpolated string from ``at`` to its quote (to the end for none), and where it ends."""
        text, n = self.text, len(self.text)
        out: Segments = []
        plain = at

        def flush(end: int) -> None:
            if end > plain:
                out.append(text[plain:end])

        while at < n:
            c = text[at]
            if c == quote:
                flush(at)
                return out or [""], at + 1
            if c == "\\":
                if m := _ESCAPE.match(text, at):
                    flush(at)
                    out.append(unescape_php_double(m[0]))
                    at = plain = m.end()
                else:
                    at += 2
            elif c == "{" and text.startswith("$", at + 1) or c == "$" and text.startswith("{", at + 1):
                flush(at)
                out.append(None)
                at = plain = yield self.code(at + 1 + (c == "$"), "}")
            elif c == "$" and (m := _SIMPLE.match(text, at)):
                flush(at)
                out.append(None)
                at = plain = m.end()
            else:
                at += 1
        flush(n)
        return out or [""], n


def _chain_start(tokens: list[Token], last: int, pairs: dict[int, int]) -> int:
    """First token of the postfix expression that ends at ``last``."""
    i = last
    while True:
        t = tokens[i]
        if t.text in (")", "]", "}") and i in pairs:
            opened = pairs[i]
            before = tokens[opened - 1] if opened else None
            if before is not None and (before.kind in ("name", "var") and before.text.lower() not in KEYWORDS or before.text in (")", "]") or before.kind == "string" and t.text == "]"):
                i = opened - 1
                continue
            i = opened
        if i and tokens[i - 1].text in ("->", "?->", "::") and tokens[i - 1].kind == "op" and i > 1:
            i -= 2
            continue
        if i and tokens[i - 1].text == "new":
            return i - 1
        return i


def _receiver(text: str, tokens: list[Token], first: int, last: int, pairs: dict[int, int]) -> str:
    names: list[str] = []
    while tokens[last].kind in ("name", "var") and last - first >= 2 and tokens[last - 1].text == "->":
        names.append(tokens[last].text)
        last -= 2
    end = tokens[last]
    own = text[tokens[first].start : end.end].lstrip("$")
    if end.text == ")" and last in pairs:
        callee = pairs[last] - 1
        plain = callee >= first and tokens[callee].kind == "name" and tokens[first].text != "new"
        if plain and (callee == first or tokens[callee - 1].text in ("->", "::")):
            own = f"{tokens[callee].text}()"
    return ".".join([own, *reversed(names)])


def _value(tokens: list[Token], first: int, last: int, pairs: dict[int, int]) -> Segments:
    """Segments of an argument: a string, or strings and other operands joined by ``.``."""
    if first + 1 < last and tokens[first].kind == "name" and tokens[first + 1].text == ":":
        first += 2  # a named argument
    while first < last and tokens[first].text in ("...", "&"):
        first += 1
    if first >= last:
        return [None]
    loose = lambda i: tokens[i].kind == "op" and tokens[i].text in LOOSE or tokens[i].kind == "name" and tokens[i].text.lower() in LOOSE_WORDS
    if len(split_top(tokens, first, last, pairs, loose)) > 1:
        return [None]
    out: Segments = []
    for a, b in split_top(tokens, first, last, pairs, lambda i: tokens[i].kind == "op" and tokens[i].text == "."):
        out += tokens[a].segments if b - a == 1 and tokens[a].segments is not None else [None]
    return out


def _calls(text: str, tokens: list[Token]) -> list[Call]:
    pairs = brackets(tokens)
    found = []
    for i, t in enumerate(tokens[:-1]):
        if t.kind != "name" or tokens[i + 1].text != "(" or i + 1 not in pairs:
            continue
        args = [_value(tokens, a, b, pairs) for a, b in arguments(tokens, i + 2, pairs[i + 1], pairs)]
        before = tokens[i - 1] if i else None
        if before is not None and before.kind == "op" and before.text in ("->", "::") and i > 1:
            first = _chain_start(tokens, i - 2, pairs)
            if before.text == "::":
                receiver = text[tokens[first].start : tokens[i - 2].end].lstrip("$")
            else:
                receiver = _receiver(text, tokens, first, i - 2, pairs)
            found.append(Call("method", t.text, receiver, args))
        elif "\\" not in t.text and t.text.lower() not in KEYWORDS and not (before is not None and (before.text in ("?->", "&") and i > 1 and tokens[i - 2].text == "function" or before.text in ("?->", "->", "::") or before.text.lower() in ("new", "function"))):
            found.append(Call("function", t.text, "", args))
    return found


def extract(text: str, specs: list[CallSpec], min_len: int) -> Facts:
    lexer = _Lexer(text)
    lexer.file()
    calls = [c for stream in lexer.streams for c in _calls(text, stream)] if specs else []
    return collect(calls, lexer.strings, specs, min_len)
