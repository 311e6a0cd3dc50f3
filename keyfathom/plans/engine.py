"""One scan: configuration, catalogs and source trees to verdicts."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfathom import config as configuration
from keyfathom.config import Config, ConfigError, Whitelist
from keyfathom.functions.calls import EXTENSIONS
from keyfathom.operators import audit as auditing
from keyfathom.operators import liveness
from keyfathom.operators.extract import extract_facts, language_of
from keyfathom.plans.report import Report
from keyfathom.sources import catalogs
from keyfathom.sources.files import glob_regex, read_tree, texts

log = logging.getLogger("keyfathom")
#: Files that can't be lexed, in the log.
SHOWN = 20


@dataclass
class Outcome:
    """Frames of a scan; nothing but the checks of its inputs has run yet."""

    config: Config
    verdicts: DataFrame
    blind: DataFrame
    facts: DataFrame
    audit: DataFrame | None = None
    kept: list[DataFrame] = field(default_factory=list)

    def report(self, alive: bool = True) -> Report:
        """Collect what a report shows, sorted by context (none first), msgid and plural; the alive keys only if asked.

        Releases what the scan has kept in memory."""
        order = (F.asc_nulls_first("msgctxt"), "msgid", F.asc_nulls_first("msgid_plural"))
        shown = self.verdicts if alive else self.verdicts.where(F.col("status") != "alive")
        rows = [r.asDict() for r in shown.orderBy(*order).toLocalIterator()]
        of = lambda s: [r for r in rows if r["status"] == s]
        counts = None if alive else self.verdicts.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "alive").alias("alive")).first().asDict()
        traced = None if self.audit is None else [r.asDict() for r in self.audit.orderBy(*order).toLocalIterator()]
        report = Report(of("dead"), of("suspect"), of("alive"), {r.family: r.n for r in self.blind.collect()}, traced, counts)
        self._log(report)
        for frame in self.kept:
            frame.unpersist()
        return report

    def _log(self, report: Report) -> None:
        if log.isEnabledFor(logging.INFO):
            of = lambda t: F.count_distinct(F.when(F.col("fact_type") == t, F.struct(F.coalesce("kind", F.lit("")), "value")))
            n = self.facts.agg(of("literal").alias("literals"), of("guard").alias("guards")).first()
            log.info("usage: %d literals, %d guards, %d blind sites", n.literals, n.guards, report.blind_total)
            log.info("universe: %d keys, of which %d alive, %d suspect, %d dead", report.total, report.alive_total, len(report.suspect), len(report.dead))
        for row in self.facts.where("fact_type = 'error'").select("path", "value").orderBy("path").limit(SHOWN).collect():
            log.warning("%s can't be lexed: %s", row.path, row.value)


def white_lines(lines: DataFrame) -> DataFrame:
    """The keys of a whitelist's lines (column value): trimmed, without blank ones and ``#`` comments."""
    trimmed = lines.select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("value"))
    return trimmed.where((F.col("value") != "") & ~F.col("value").startswith("#"))


def whitelist(spark: SparkSession, white: Whitelist, base: Path) -> DataFrame:
    """(value): inline keys as they are, and the trimmed lines of the file but blanks and ``#`` comments."""
    inline = spark.createDataFrame([(k,) for k in white.keys], "value string")
    if white.file is None:
        return inline.distinct()
    path = base / white.file
    if not path.is_file():
        raise ConfigError(f"{path}: the whitelist can't be read")
    return inline.union(white_lines(spark.read.text(path.resolve().as_uri()))).distinct()


def source_files(spark: SparkSession, config: Config, roots: list[str]) -> DataFrame:
    """(path, lang, content) of the files whose extension is configured and known."""
    extensions = [x.lower() for x in config.scan.source_extensions if x.lower() in EXTENSIONS]
    files = read_tree(spark, roots, config.scan.ignore_dirs, extensions or ["\0"])
    extension = F.regexp_extract("rel", r"\.([^./]*)$", 1)
    return texts(files).select(F.col("abs").alias("path"), language_of(extension).alias("lang"), "content")


def run(spark: SparkSession, config_path: str | Path, project_root: str | Path, run_audit: bool = False) -> Outcome:
    """Scan a project. The whitelist lies beside the configuration; roots are relative to the project."""
    config = configuration.load(config_path)
    base = Path(config_path).parent
    white = whitelist(spark, config.whitelist, base)
    roots = [str(Path(project_root) / r) for r in config.scan.source_roots]
    for pattern in config.scan.po_patterns:
        glob_regex(pattern)
    keys = catalogs.load(read_tree(spark, roots, config.scan.ignore_dirs, (), config.scan.po_patterns).select(F.col("abs").alias("path"), "content"))
    sources = source_files(spark, config, roots)
    log.info("scanning %d roots", len(roots))
    if run_audit:
        sources = sources.persist()  # read again by the audit
    facts = extract_facts(sources, config.calls, config.guard_min_len).persist()
    verdicts = liveness.classify(keys, facts, white).persist()
    kept = [keys, facts, verdicts] + [sources] * run_audit
    audit = None
    if run_audit:
        audit = auditing.audit(verdicts.where(F.col("status") == "dead"), sources, config.guard_min_len)
    return Outcome(config, verdicts, liveness.blind_by_family(facts), facts, audit, kept)
