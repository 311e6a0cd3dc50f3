"""Source trees: a directory walk that honours ignore files, globs, and a Python data source that reads the files."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FILES_PER_PARTITION = 200


def glob_regex(pattern: str, slash: bool = False) -> str:
    """An anchored regex for a glob. ``**/`` is any number of directories; ``*`` and ``?`` stop at ``/`` if ``slash``."""
    any_ = "[^/]" if slash else "."
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (not i or pattern[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + f"{any_}*", i + 1
        elif c == "?":
            out, i = out + any_, i + 1
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                raise ValueError(f"bad glob {pattern!r}: [ is not closed")
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        elif c == "{":
            end = pattern.find("}", i)
            if end < 0:
                raise ValueError(f"bad glob {pattern!r}: {{ is not closed")
            out, i = out + "(?:" + "|".join(glob_regex(p, slash)[4:-3] for p in pattern[i + 1 : end].split(",")) + ")", end + 1
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return f"(?s:{out})\\Z"


@dataclass(frozen=True)
class Rule:
    regex: re.Pattern
    keep: bool
    only_dirs: bool


def ignore_rules(text: str) -> list[Rule]:
    """Rules of an ignore file, in order; bad lines are skipped."""
    rules = []
    for line in text.splitlines():
        line = line if line.endswith("\\ ") else line.rstrip()
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line[keep:]
        if line.startswith(("\\#", "\\!")):
            line = line[1:]
        only_dirs = line.endswith("/")
        line = line.rstrip("/")
        rooted = "/" in line
        try:
            body = glob_regex(line.lstrip("/") if rooted else "**/" + line, slash=True)
            rules.append(Rule(re.compile(body), keep, only_dirs))
        except (ValueError, re.error):
            continue
    return rules


def _read(path: Path) -> list[Rule]:
    try:
        return ignore_rules(path.read_text("utf-8", "replace"))
    except OSError:
        return []


def _global_rules() -> list[Rule]:
    """Of the ignore file that git applies to all repositories of a user, where it is at its usual place."""
    home = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
    return _read(Path(home, "git", "ignore"))


def _repository_rules(top: Path) -> list[Rule]:
    """Of the repository at ``top`` itself; they yield to those of the ignore files in its folders."""
    return _read(top / ".git" / "info" / "exclude")


def _ignored(path: str, is_dir: bool, levels: list[tuple[str, list[Rule]]]) -> bool:
    """The last rule of the nearest file that fits decides."""
    for base, rules in reversed(levels):
        rel = os.path.relpath(path, base)
        for rule in reversed(rules):
            if (is_dir or not rule.only_dirs) and rule.regex.match(rel):
                return not rule.keep
    return False


def walk(roots: Sequence[str | Path], ignore_dirs: Sequence[str]) -> list[tuple[str, str, str]]:
    """(root, rel, abs) of the regular files, sorted by abs and listed once.

    Directories named in ``ignore_dirs`` are not entered, at any depth below a root; nor are hidden entries and those
    that ``.ignore`` files, or inside a git repository ``.gitignore`` files, its exclude file and the user's ignore file,
    exclude. Links are not followed. A root
    that can't be read is an error."""
    found: dict[str, tuple[str, str, str]] = {}
    skip = set(ignore_dirs)
    for root in map(str, roots):
        if not os.path.exists(root):
            raise FileNotFoundError(f"{root}: no such directory")
        real = Path(root).resolve()
        above = [real, *real.parents]
        git = next((i for i, p in enumerate(above) if (p / ".git").exists()), None)
        levels: list[tuple[str, list[Rule]]] = []
        if git is not None and (rules := _global_rules() + _repository_rules(above[git])):
            levels.append((os.path.relpath(above[git], real), rules))
        for i in range(len(above) - 1, 0, -1):
            rules = _read(above[i] / ".gitignore") if git is not None and i <= git else []
            rules += _read(above[i] / ".ignore")
            if rules:
                levels.append((os.path.relpath(above[i], real), rules))
        levels = [(os.path.normpath(os.path.join(root, base)), rules) for base, rules in levels]

        def enter(folder: str, levels: list, in_git: bool, root: str = root) -> None:
            if not in_git and os.path.exists(os.path.join(folder, ".git")):
                in_git = True
                if rules := _global_rules() + _repository_rules(Path(folder)):
                    levels = [*levels, (folder, rules)]
            rules = (_read(Path(folder, ".gitignore")) if in_git else []) + _read(Path(folder, ".ignore"))
            levels = [*levels, (folder, rules)] if rules else levels
            with os.scandir(folder) as entries:
                for e in sorted(entries, key=lambda e: e.name):
                    is_dir = e.is_dir(follow_symlinks=False)
                    if e.name.startswith(".") or is_dir and e.name in skip or _ignored(e.path, is_dir, levels):
                        continue
                    if is_dir:
                        enter(e.path, levels, in_git)
                    elif e.is_file(follow_symlinks=False):
                        found.setdefault(e.path, (root, os.path.relpath(e.path, root), e.path))

        enter(root, levels, git is not None)
    return [found[p] for p in sorted(found)]


@dataclass
class _Part(InputPartition):
    files: list[tuple[str, str, str]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.roots = options["roots"].split("\n")
        self.skip = [x for x in options.get("ignoreDirs", "").split("\n") if x]
        self.extensions = {x for x in options.get("extensions", "").split("\n") if x}
        self.patterns = [re.compile(glob_regex(x)) for x in options.get("patterns", "").split("\n") if x]

    def _wanted(self, rel: str, abs_: str) -> bool:
        extension = os.path.splitext(rel)[1][1:].lower()
        return (not self.extensions or extension in self.extensions) and (not self.patterns or any(p.match(rel) or p.match(abs_) for p in self.patterns))

    def partitions(self) -> list[_Part]:
        files = [f for f in walk(self.roots, self.skip) if self._wanted(f[1], f[2])]
        return [_Part(files[i : i + FILES_PER_PARTITION]) for i in range(0, len(files), FILES_PER_PARTITION)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple[str, str, str, bytes | None]]:
        for root, rel, abs_ in partition.files:
            try:
                content = Path(abs_).read_bytes()
            except OSError:
                content = None
            yield root, rel, abs_, content


class SourceTree(DataSource):
    """``spark.read.format("source_tree")`` with options roots, ignoreDirs, extensions and patterns, one a line.

    The walk prunes on the driver and each partition reads its own files, so roots must be on storage that all
    executors mount."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "root string, rel string, abs string, content binary"

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(self.options)


def read_tree(spark: SparkSession, roots: Sequence[str | Path], ignore_dirs: Sequence[str] = (), extensions: Sequence[str] = (), patterns: Sequence[str] = ()) -> DataFrame:
    spark.dataSource.register(SourceTree)
    options = {"roots": roots, "ignoreDirs": ignore_dirs, "extensions": extensions, "patterns": patterns}
    return spark.read.format("source_tree").options(**{k: "\n".join(map(str, v)) for k, v in options.items()}).load()


def texts(files: DataFrame) -> DataFrame:
    """``content`` as text; what is no valid UTF-8 becomes empty."""
    return files.withColumn("content", F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.lit("")))


def listed(files: DataFrame, ignore_dirs: Sequence[str]) -> DataFrame:
    """What ``walk`` keeps of a listing (column path, ``/`` between its parts) that comes from elsewhere, as from a store
    without folders: each path once, and none below a folder of an ignored name."""
    parts = F.split("path", "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    skip = F.array(*map(F.lit, ignore_dirs)).cast("array<string>")
    return files.where(~F.arrays_overlap(folders, skip)).dropDuplicates(["path"])
