"""Usage facts of source files: (path, family, fact_type, kind, value, n).

fact_type is literal, guard (with kind prefix, suffix or contains), blind (n sites), source_literal, or error (a file
that can't be lexed: value says why, and it has no other row). PHP and the
JavaScript family are lexed in Arrow batches; Twig is regular expressions and stays in the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfathom.config import CallSpec
from keyfathom.functions import js, php
from keyfathom.functions.calls import EXTENSIONS, FAMILY, Facts, applicable

SCHEMA = "path string, family string, fact_type string, kind string, value string, n long"
#: What counts as a quoted string in a template (fixed pattern).
TWIG_STRING = r"""'([^'\n]*)'|"([^"\n]*)\""""


def extract_text(lang: str, text: str, specs: Sequence[CallSpec], min_len: int) -> Facts:
    """Facts of one PHP or JavaScript-family text."""
    own = applicable(list(specs), lang)
    return php.extract(text, own, min_len) if lang == "php" else js.extract(lang, text, own, min_len)


def _rows(lang: str, text: str, specs: Sequence[CallSpec], min_len: int) -> list[tuple[str, str | None, str | None, int]]:
    try:
        return extract_text(lang, text, specs, min_len).rows()
    except Exception as e:  # noqa: BLE001  whatever one file does, the others are scanned
        return [("error", None, f"{type(e).__name__}: {e}", 1)]


def lexed_facts(files: DataFrame, specs: Sequence[CallSpec], min_len: int) -> DataFrame:
    """Facts of ``files`` (path, lang, content) in PHP or the JavaScript family. A null content counts as empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, lang, content = (c.to_pylist() for c in batch.columns)
            rows = [(p, FAMILY[g], *row) for p, g, text in zip(path, lang, content, strict=True) for row in _rows(g, text or "", specs, min_len)]
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["path", "family", "fact_type", "kind", "value", "n"])

    return files.where(F.col("lang") != "twig").select("path", "lang", "content").mapInArrow(run, SCHEMA)


def _quoted(name: str) -> str:
    return r"\Q" + name.replace(r"\E", r"\E\\E\Q") + r"\E"


def twig_literals(content: Column) -> Column:
    """All quoted strings but empty and interpolated ones, quotes off."""
    inner = F.transform(F.regexp_extract_all(content, F.lit(TWIG_STRING), F.lit(0)), lambda s: F.substring(s, F.lit(2), F.char_length(s) - 2))
    return F.filter(inner, lambda s: (s != "") & ~s.contains("#{"))


def twig_filter_keys(content: Column, name: str) -> Column:
    """Quoted keys to which the filter is applied directly, with repeats."""
    # fixed pattern
    found = F.regexp_extract_all(content, F.lit(rf"(?U)['\"]([^'\"]*)['\"]\s*\|\s*{_quoted(name)}\b"), F.lit(1))
    return F.filter(found, lambda s: ~s.contains("#{"))


def twig_filter_blind(content: Column, name: str) -> Column:
    """Uses of the filter beyond those with a key."""
    # fixed pattern
    uses = F.regexp_count(content, F.lit(rf"(?U)\|\s*{_quoted(name)}\b"))
    return F.greatest(uses - F.size(twig_filter_keys(content, name)), F.lit(0)).cast("long")


def twig_facts(files: DataFrame, specs: Sequence[CallSpec]) -> DataFrame:
    """Facts of the Twig files among ``files``. Escapes are not decoded; a filter listed twice counts its blind uses twice."""
    own = files.where(F.col("lang") == "twig").select("path", F.coalesce("content", F.lit("")).alias("content"))
    row = lambda fact, value, n: F.struct(F.lit(fact).alias("fact_type"), value.cast("string").alias("value"), n.cast("long").alias("n"))
    text = F.col("content")
    parts = [F.transform(F.array_distinct(twig_literals(text)), lambda s: row("source_literal", s, F.lit(1)))]
    filters = [s for s in applicable(list(specs), "twig") if s.kind == "filter"]
    if filters:
        keys = F.array_distinct(F.flatten(F.array(*[twig_filter_keys(text, s.name) for s in filters])))
        parts.append(F.transform(keys, lambda s: row("literal", s, F.lit(1))))
        blind = sum((twig_filter_blind(text, s.name) for s in filters), F.lit(0).cast("long"))
        parts.append(F.filter(F.array(row("blind", F.lit(None), blind)), lambda r: r["n"] > 0))
    rows = own.select("path", F.explode(F.concat(*parts)).alias("r"))
    return rows.select("path", F.lit("twig").alias("family"), "r.fact_type", F.lit(None).cast("string").alias("kind"), "r.value", "r.n")


def extract_facts(files: DataFrame, specs: Sequence[CallSpec], min_len: int) -> DataFrame:
    """Facts of all files; works on a stream of files too."""
    return lexed_facts(files, specs, min_len).unionByName(twig_facts(files, specs))


def language_of(extension: Column) -> Column:
    """Language of a file extension in any case; null for unknown ones."""
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.try_element_at(table, F.lower(extension))


def first_match(sites: DataFrame, specs: DataFrame) -> DataFrame:
    """The relational form of spec matching: for each site (site, kind, name, receiver) the first of ``specs`` (ord,
    kind, name, receiver array) that fits. Specs without receivers take any."""
    s = specs.withColumnsRenamed({"kind": "spec_kind", "name": "spec_name", "receiver": "spec_receiver"})
    fits = (sites["kind"] == s["spec_kind"]) & (sites["name"] == s["spec_name"]) & (s["spec_receiver"].isNull() | F.array_contains(s["spec_receiver"], sites["receiver"]))
    return sites.join(s, fits).groupBy("site").agg(F.min("ord").alias("ord"))
