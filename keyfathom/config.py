"""Project configuration: a TOML file read into frozen dataclasses on the driver."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


class ConfigError(ValueError):
    """The configuration can't be used; the message names the file or key."""


#: Values that a configuration may name (fixed values).
KINDS = ("function", "method", "filter", "index")
FORMATS = ("text", "json")
FAIL_ON = ("dead", "dead-or-blind", "never")


@dataclass(frozen=True)
class CallSpec:
    lang: str
    kind: str
    name: str
    receiver: tuple[str, ...] | None = None
    key_arg_index: int = 0


@dataclass(frozen=True)
class Scan:
    # what is scanned by default (fixed values)
    po_patterns: tuple[str, ...] = ("**/*.po", "**/*.pot")
    source_extensions: tuple[str, ...] = ("php", "twig", "js", "ts", "jsx", "tsx")
    ignore_dirs: tuple[str, ...] = ("vendor", "node_modules", "cache", "var")
    source_roots: tuple[str, ...] = (".",)


@dataclass(frozen=True)
class Output:
    format: str | None = None
    fail_on: str = "dead"
    max_dead: int | None = None
    max_dead_ratio: float | None = None


@dataclass(frozen=True)
class Whitelist:
    file: str | None = None
    keys: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    scan: Scan = field(default_factory=Scan)
    calls: tuple[CallSpec, ...] = ()
    guard_min_len: int = 3
    output: Output = field(default_factory=Output)
    whitelist: Whitelist = field(default_factory=Whitelist)


def _strings(value: Any, key: str) -> tuple[str, ...]:
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise ConfigError(f"{key} must be a list of strings")
    return tuple(value)


def _text(value: Any, key: str) -> str:
    if not isinstance(value, str):
        raise ConfigError(f"{key} must be a string")
    return value


def _count(value: Any, key: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise ConfigError(f"{key} must be a whole number of at least 0")
    return value


def _one_of(value: Any, key: str, known: tuple[str, ...]) -> str:
    if value not in known:
        raise ConfigError(f"{key} must be one of {', '.join(known)}")
    return value


def parse(raw: dict[str, Any]) -> Config:
    """Unknown keys are ignored. The former key ``[output] min_guard_len`` is an error, so nobody relies on it."""
    if "min_guard_len" in raw.get("output", {}):
        raise ConfigError("[output] min_guard_len has moved to [guard] min_len")
    scan, output, white = raw.get("scan", {}), raw.get("output", {}), raw.get("whitelist", {})
    calls = []
    for i, c in enumerate(raw.get("calls", [])):
        at = f"[[calls]] {i}"
        for need in ("lang", "kind", "name"):
            if need not in c:
                raise ConfigError(f"{at}: {need} is missing")
        receiver = _strings(c["receiver"], f"{at} receiver") if "receiver" in c else None
        calls.append(CallSpec(_text(c["lang"], f"{at} lang"), _one_of(c["kind"], f"{at} kind", KINDS), _text(c["name"], f"{at} name"), receiver, _count(c.get("key_arg_index", 0), f"{at} key_arg_index")))
    known = Scan()
    ratio = output.get("max_dead_ratio")
    if ratio is not None and (isinstance(ratio, bool) or not isinstance(ratio, (int, float))):
        raise ConfigError("[output] max_dead_ratio must be a number")
    return Config(
        Scan(*(_strings(scan.get(k, list(getattr(known, k))), f"[scan] {k}") for k in ("po_patterns", "source_extensions", "ignore_dirs", "source_roots"))),
        tuple(calls),
        _count(raw.get("guard", {}).get("min_len", 3), "[guard] min_len"),
        Output(
            _one_of(output["format"], "[output] format", FORMATS) if "format" in output else None,
            _one_of(output.get("fail_on", "dead"), "[output] fail_on", FAIL_ON),
            _count(output["max_dead"], "[output] max_dead") if "max_dead" in output else None,
            None if ratio is None else float(ratio),
        ),
        Whitelist(_text(white["file"], "[whitelist] file") if "file" in white else None, _strings(white.get("keys", []), "[whitelist] keys")),
    )


def load(path: str | Path) -> Config:
    """Read and check a file; errors carry its path."""
    try:
        raw = tomllib.loads(Path(path).read_text("utf-8"))
    except OSError as e:
        raise ConfigError(f"{path}: can't be read ({e.strerror})") from e
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        raise ConfigError(f"{path}: not valid TOML ({e})") from e
    try:
        return parse(raw)
    except ConfigError as e:
        raise ConfigError(f"{path}: {e}") from e
