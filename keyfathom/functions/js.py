"""JavaScript, TypeScript and JSX: a lexer, and the calls in its token streams."""

from __future__ import annotations

import re

from keyfathom.config import CallSpec
from keyfathom.functions.calls import Call, Facts, Task, Token, arguments, brackets, collect, split_top, trampoline
from keyfathom.functions.strings import Segments, unescape_js

_SKIP = re.compile(r"\s+|//[^\r\n]*|/\*.*?(?:\*/|\Z)", re.S)
_STRING = re.compile(r"'(?:[^'\\\r\n]|\\.)*'?|\"(?:[^\"\\\r\n]|\\.)*\"?", re.S)
_NAME = re.compile(r"#?[A-Za-z_$\x80-\U0010ffff][\w$\x80-\U0010ffff]*")
_NUMBER = re.compile(r"0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\r\n]|\\.|\[(?:[^\]\\\r\n]|\\.)*\])+/[A-Za-z]*")
_OPS = sorted(["=>", "===", "!==", "==", "!=", "<=", ">=", "&&=", "||=", "??=", "&&", "||", "??", "?.", "...", "**=", "**", "++", "--", "<<=", ">>>=", ">>=", "<<", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^="], key=len, reverse=True)
_ESCAPE = re.compile(r"\\(?:u\{[0-9A-Fa-f]+\}|u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|\r\n|.)", re.S)
_TAG = re.compile(r"<(?=[A-Za-z_$>])")
_TAG_NAME = re.compile(r"[\w$.:\-]*")
_ATTRIBUTE = re.compile(r"'[^']*'?|\"[^\"]*\"?")

#: Words after which an expression begins (fixed values).
BEFORE_VALUE = set("return typeof instanceof in of new delete void throw case do else yield await default extends".split())
#: Words before a parenthesis that make no function call (fixed values).
KEYWORDS = BEFORE_VALUE | set("if for while switch catch function with import super class async let const var".split())
#: Top-level operators that bind weaker than ``+`` (fixed values).
LOOSE = set("? : ?? && || == != === !== < > <= >= << >> >>> = += -= *= /= %= **= &&= ||= ??= &= |= ^= <<= >>= >>>= & | ^ => ; , !".split())
LOOSE_WORDS = {"in", "instanceof", "as", "satisfies", "yield", "function", "class"}
ENDS = {")", "]", "}"}


class _Lexer:
    def __init__(self, text: str, jsx: bool) -> None:
        self.text, self.jsx = text, jsx
        self.streams: list[list[Token]] = []
        self.strings: list[Segments] = []

    # Nesting is as deep as a file makes it, so each part is a task of ``trampoline``, not a call.

    def code(self, at: int, stop: bool = False) -> Task[int]:
        """Tokens to the end, or to an unmatched ``}``; where the text goes on."""
        text, n = self.text, len(self.text)
        out: list[Token] = []
        self.streams.append(out)
        depth = 0
        while at < n:
            if m := _SKIP.match(text, at):
                at = m.end()
                continue
            c, last = text[at], out[-1] if out else None
            value = last is None or last.kind == "op" and last.text not in ENDS and last.text not in ("++", "--") or last.kind == "name" and last.text in BEFORE_VALUE and not (len(out) > 1 and out[-2].text == ".")
            if stop and c == "}" and not depth:
                return at + 1
            if c in "'\"":
                m = _STRING.match(text, at)
                inner = m[0][1:-1] if len(m[0]) > 1 and m[0][-1] == c else m[0][1:]
                segments: Segments = [unescape_js(inner)]
                out.append(Token("string", m[0], at, m.end(), segments))
                self.strings.append(segments)
                at = m.end()
            elif c == "`":
                begin = at
                segments, at = yield self.template(at + 1)
                out.append(Token("string", text[begin:at], begin, at, segments))
                self.strings.append(segments)
            elif m := _NAME.match(text, at):
                out.append(Token("name", m[0], at, m.end()))
                at = m.end()
            elif m := _NUMBER.match(text, at):
                out.append(Token("number", m[0], at, m.end()))
                at = m.end()
            elif c == "/" and value and (m := _REGEX.match(text, at)):
                out.append(Token("other", m[0], at, m.end()))
                at = m.end()
            elif c == "<" and self.jsx and (value or last.text in ("}", ")") and text[at - 1 : at].isspace()) and _TAG.match(text, at):
                begin = at
                at = yield self.element(at)
                out.append(Token("other", text[begin:at], begin, at))
            else:
                op = next((o for o in _OPS if text.startswith(o, at)), c)
                if op == "?." and text[at + 2 : at + 3].isdigit():
                    op = "?"
                depth += (op in ("(", "[", "{")) - (op in (")", "]", "}"))
                out.append(Token("op", op, at, at + len(op)))
                at += len(op)
        return n

    def template(self, at: int) -> Task[tuple[Segments, int]]:
        text, n = self.text, len(self.text)
        out: Segments = []
        plain = at
        while at < n:
            c = text[at]
            if c == "`" or c == "\\" or text.startswith("${", at):
                if at > plain:
                    out.append(text[plain:at])
                if c == "`":
                    return out or [""], at + 1
                if c == "\\":
                    m = _ESCAPE.match(text, at)
                    out.append(unescape_js(m[0]) if m else "\\")
                    at = plain = m.end() if m else n
                else:
                    out.append(None)
                    at = plain = yield self.code(at + 2, True)
            else:
                at += 1
        if n > plain:
            out.append(text[plain:])
        return out or [""], n

    def element(self, at: int) -> Task[int]:
        """A JSX element from its ``<``; where it ends."""
        text, n = self.text, len(self.text)
        at = _TAG_NAME.match(text, at + 1).end()
        while at < n and text[at] != ">":
            if text.startswith("/>", at):
                return at + 2
            if text[at] == "{":
                at = yield self.code(at + 1, True)
            elif m := _ATTRIBUTE.match(text, at):
                self.strings.append([unescape_js(m[0][1:-1])])
                at = m.end()
            else:
                at += 1
        at += 1
        while at < n:
            if text.startswith("</", at):
                close = text.find(">", at)
                return n if close < 0 else close + 1
            if text[at] == "{":
                at = yield self.code(at + 1, True)
            elif _TAG.match(text, at):
                at = yield self.element(at)
            else:
                at += 1
        return n


def _chain_start(tokens: list[Token], last: int, pairs: dict[int, int]) -> int:
    i = last
    while True:
        t = tokens[i]
        if t.text in (")", "]") and t.kind == "op" and i in pairs:
            opened = pairs[i]
            before = tokens[opened - 1] if opened else None
            if before is not None and (before.kind == "name" and before.text not in KEYWORDS - {"super"} or before.kind == "op" and before.text in (")", "]", "?.") or before.kind == "string" and t.text == "]"):
                i = opened - 1 - (before.text == "?.")
                continue
            i = opened
        if t.kind == "op" and t.text == "!" and i:
            i -= 1
            continue
        if i > 1 and tokens[i - 1].kind == "op" and tokens[i - 1].text in (".", "?."):
            i -= 2
            continue
        if i and tokens[i - 1].text == "new":
            return i - 1
        return i


def _receiver(text: str, tokens: list[Token], first: int, last: int) -> str:
    names: list[str] = []
    while tokens[last].kind == "name" and last - first >= 2 and tokens[last - 1].text in (".", "?.") and tokens[first].text != "new":
        names.append(tokens[last].text)
        last -= 2
    return ".".join([text[tokens[first].start : tokens[last].end], *reversed(names)])


def _value(tokens: list[Token], first: int, last: int, pairs: dict[int, int]) -> Segments:
    """Segments of an argument: a string, a template, or such and other operands joined by ``+``."""
    ends = lambda i: i > first and (tokens[i - 1].kind != "op" or tokens[i - 1].text in ENDS)
    loose = lambda i: tokens[i].kind == "op" and tokens[i].text in LOOSE and not (tokens[i].text == "!" and not ends(i)) or tokens[i].kind == "name" and tokens[i].text in LOOSE_WORDS and not (i > first and tokens[i - 1].text == ".")
    if len(split_top(tokens, first, last, pairs, loose)) > 1:
        return [None]
    out: Segments = []
    marks: list[str] = []
    sign = lambda i: tokens[i].kind == "op" and tokens[i].text in ("+", "-") and ends(i)
    parts = split_top(tokens, first, last, pairs, lambda i: sign(i) and not marks.append(tokens[i].text))
    for k, (a, b) in enumerate(parts):
        own = tokens[a].segments if b - a == 1 and tokens[a].segments is not None else [None]
        out = [None] if k and marks[k - 1] == "-" else out + own
    return out


def _calls(text: str, tokens: list[Token]) -> list[Call]:
    pairs = brackets(tokens)
    found = []
    for i, t in enumerate(tokens):
        if t.kind != "op" or t.text not in ("(", "[") or i not in pairs or not i:
            continue
        optional = tokens[i - 1].text == "?." and tokens[i - 1].kind == "op"
        at = i - 1 - optional
        if at < 0:
            continue
        end = tokens[at]
        if t.text == "[":
            ended = end.kind == "string" or end.kind == "op" and end.text in (")", "]", "!") or end.kind == "name" and (end.text not in KEYWORDS or end.text == "super" or at and tokens[at - 1].text == ".")
            if end.kind == "op" and end.text == "!" and not (at and (tokens[at - 1].kind == "name" or tokens[at - 1].text in (")", "]"))):
                ended = False
            if not ended or pairs[i] == i + 1:
                continue
            first = _chain_start(tokens, at, pairs)
            found.append(Call("index", _receiver(text, tokens, first, at), "", [_value(tokens, i + 1, pairs[i], pairs)]))
            continue
        if end.kind != "name":
            continue
        member = at > 1 and tokens[at - 1].kind == "op" and tokens[at - 1].text in (".", "?.")
        if not member and (end.text in KEYWORDS or end.text == "this" or at and tokens[at - 1].text in ("new", "function")):
            continue
        after = tokens[pairs[i] + 1] if pairs[i] + 1 < len(tokens) else None
        if not member and after is not None and after.text == "{" and (not at or tokens[at - 1].text in ("{", "}", ";", ",", "async", "static", "get", "set", "*")):
            continue  # the head of a method
        args = [_value(tokens, a, b, pairs) for a, b in arguments(tokens, i + 1, pairs[i], pairs)]
        if member:
            first = _chain_start(tokens, at - 2, pairs)
            if tokens[first].text == "new" and first == at - 3:
                continue
            found.append(Call("method", end.text, _receiver(text, tokens, first, at - 2), args))
        else:
            found.append(Call("function", end.text, "", args))
    return found


def extract(lang: str, text: str, specs: list[CallSpec], min_len: int) -> Facts:
    lexer = _Lexer(text, lang != "ts")
    trampoline(lexer.code(0))
    calls = [c for stream in lexer.streams for c in _calls(text, stream)] if specs else []
    return collect(calls, lexer.strings, specs, min_len)
