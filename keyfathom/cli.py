"""Command line: ``python -m keyfathom scan``."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from keyfathom.config import FORMATS
from keyfathom.operators import gate
from keyfathom.plans.engine import run
from keyfathom.plans.report import render


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("keyfathom", description="Find unused translation keys.")
    scan = p.add_subparsers(dest="command", required=True).add_parser("scan", help="scan a project")
    scan.add_argument("path", nargs="?", default=".", help="the project's root")
    scan.add_argument("-c", "--config", default="keyfathom.toml")
    scan.add_argument("-f", "--format", type=str.lower, choices=FORMATS, help="the configured one by default, else text")
    scan.add_argument("-v", "--verbose", action="count", default=0)
    scan.add_argument("--audit", action="store_true", help="look for traces of dead keys in raw source")
    scan.add_argument("--max-dead", type=int, metavar="N", help="fail only beyond N dead keys")
    scan.add_argument("--max-dead-ratio", type=float, metavar="R", help="fail only beyond this share of dead keys")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 or 1 by the gate; 2 for any error, which goes to stderr."""
    args = parser().parse_args(argv)
    logging.basicConfig(level=[logging.WARNING, logging.INFO, logging.DEBUG][min(args.verbose, 2)], stream=sys.stderr)
    for noisy in ("py4j", "pyspark"):
        logging.getLogger(noisy).setLevel(logging.WARNING)
    try:
        if args.max_dead is not None and args.max_dead < 0:
            raise ValueError("--max-dead must be at least 0")
        session = spark or SparkSession.builder.appName("keyfathom").getOrCreate()
        outcome = run(session, args.config, args.path, args.audit)
        budget = gate.resolve(args.max_dead, args.max_dead_ratio, outcome.config.output)
        form = args.format or outcome.config.output.format or "text"
        report = outcome.report(alive=form == "json")
        sys.stdout.write(render(report, budget, form, sys.stdout.isatty()))
        return gate.exit_code(len(report.dead), report.total, report.blind_total, outcome.config.output.fail_on, budget)
    except Exception as e:  # noqa: BLE001  whatever goes wrong is an operational error
        print(f"error: {e}", file=sys.stderr)
        return 2


def entry() -> None:
    sys.exit(main())
