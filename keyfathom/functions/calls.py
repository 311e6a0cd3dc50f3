"""From tokens to usage facts: which calls match a spec, and what their key argument says."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Generator
from dataclasses import dataclass, field
from typing import Any

from keyfathom.config import CallSpec
from keyfathom.functions.strings import Segments, guards

FAMILY = {"php": "php", "twig": "twig", "js": "js", "jsx": "js", "ts": "js", "tsx": "js"}
#: Extensions and their languages (fixed values).
EXTENSIONS = {"php": "php", "twig": "twig", "js": "js", "mjs": "js", "cjs": "js", "jsx": "jsx", "ts": "ts", "mts": "ts", "cts": "ts", "tsx": "tsx"}
_JS_NAMES = {"js", "jsx", "ts", "tsx", "javascript", "typescript"}


@dataclass(slots=True)
class Token:
    """kind: name, var, string, number, op, other. ``segments`` is set for strings and templates."""

    kind: str
    text: str
    start: int
    end: int
    segments: Segments | None = None


@dataclass(slots=True)
class Call:
    kind: str
    name: str
    receiver: str
    args: list[Segments]


@dataclass
class Facts:
    literals: set[str] = field(default_factory=set)
    guards: list[tuple[str, str]] = field(default_factory=list)
    blind: int = 0
    source_literals: set[str] = field(default_factory=set)

    def rows(self) -> list[tuple[str, str | None, str | None, int]]:
        """(fact_type, kind, value, n); equal guards of a file are one row with their count."""
        out: list[tuple[str, str | None, str | None, int]] = [("literal", None, v, 1) for v in sorted(self.literals)]
        out += [("guard", k, v, n) for (k, v), n in sorted(Counter(self.guards).items())]
        out += [("source_literal", None, v, 1) for v in sorted(self.source_literals)]
        return out + ([("blind", None, None, self.blind)] if self.blind else [])


def applicable(specs: list[CallSpec], lang: str) -> list[CallSpec]:
    """Specs for a language, in order. Any name of the JavaScript family stands for all of it."""
    family = FAMILY[lang]
    return [s for s in specs if (s.lang.lower() in _JS_NAMES if family == "js" else s.lang.lower() == family)]


def record(facts: Facts, segments: Segments, min_len: int) -> None:
    """A key without holes is a literal; one with holes gives guards, or is blind if none is long enough."""
    if None not in segments:
        facts.literals.add("".join(s for s in segments if s is not None))
        return
    found = guards(segments, min_len)
    facts.guards += found
    facts.blind += not found


def collect(calls: list[Call], strings: list[Segments], specs: list[CallSpec], min_len: int) -> Facts:
    """The first matching spec decides, even if the call has no argument at its index; then nothing is recorded."""
    facts = Facts()
    for s in strings:
        if None not in s and (value := "".join(x for x in s if x is not None)):
            facts.source_literals.add(value)
    for call in calls:
        for spec in specs:
            if spec.kind != call.kind or spec.name != call.name:
                continue
            if call.kind == "method" and spec.receiver is not None and call.receiver not in spec.receiver:
                continue
            at = 0 if call.kind == "index" else spec.key_arg_index
            if at < len(call.args):
                record(facts, call.args[at], min_len)
            break
    return facts


#: A parser's step: yields the steps that it needs, gets their results, and returns its own.
type Task[T] = Generator[Task, Any, T]


def trampoline[T](task: Task[T]) -> T:
    """Run a task and those that it yields on a stack of our own, which grows with the heap."""
    stack: list[Generator] = [task]
    value: Any = None
    while True:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
            if not stack:
                return value


CLOSE = {"(": ")", "[": "]", "{": "}"}


def brackets(tokens: list[Token]) -> dict[int, int]:
    """Positions of matching brackets, both ways. Stray brackets match nothing."""
    open_: list[int] = []
    pairs: dict[int, int] = {}
    for i, t in enumerate(tokens):
        if t.kind != "op":
            continue
        if t.text in CLOSE:
            open_.append(i)
        elif t.text in ")]}":
            while open_ and CLOSE[tokens[open_[-1]].text] != t.text:
                open_.pop()
            if open_:
                j = open_.pop()
                pairs[i], pairs[j] = j, i
    return pairs


def split_top(tokens: list[Token], first: int, last: int, pairs: dict[int, int], mark: Callable[[int], bool]) -> list[tuple[int, int]]:
    """Ranges of tokens in [first, last) between the top-level positions that ``mark`` picks."""
    out, begin, i = [], first, first
    while i < last:
        if tokens[i].kind == "op" and tokens[i].text in CLOSE and i in pairs:
            i = pairs[i] + 1
            continue
        if mark(i):
            out.append((begin, i))
            begin = i + 1
        i += 1
    out.append((begin, last))
    return out


def arguments(tokens: list[Token], first: int, last: int, pairs: dict[int, int]) -> list[tuple[int, int]]:
    """Ranges of the arguments between two parentheses; a trailing comma adds none."""
    parts = split_top(tokens, first, last, pairs, lambda i: tokens[i].kind == "op" and tokens[i].text == ",")
    return [p for p in parts if p[0] < p[1]]
