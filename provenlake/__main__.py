"""Command line: python -m provenlake audit | audit-bundle | calibrate."""

from __future__ import annotations

import argparse
import dataclasses
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import audit
from .operators import adapt, rules
from .sources import deviations, gold, reports, settings, traces, writeback
from .sources.files import SourceError
from .sources.named_files import overlaps, write_named
from .tables import settled


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="provenlake", description="Evidence audits of claims, on Spark.")
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("audit", help="drafts against supplied evidence")
    one.add_argument("drafts", nargs="+", help="Markdown or plain text drafts, files or folders")
    one.add_argument("--evidence", required=True, nargs="+", help="YAML or JSON evidence: a file for every draft, or one of each draft's name")
    one.add_argument("--out", required=True, help="folder of the Markdown reports")
    one.add_argument("--json-out", help="folder of the JSON reports")
    one.add_argument("--one-file", action="store_true", help="the evidence is one file that all drafts meet")
    two = commands.add_parser("audit-bundle", help="sealed bundles below a folder")
    two.add_argument("bundles", help="folder that holds one folder a bundle")
    two.add_argument("--out", required=True, help="folder of the audited copies, made afresh")
    two.add_argument("--reports", help="folder of the Markdown reports")
    two.add_argument("--faults", help="folder of a table of the faults of bundles that were left out")
    two.add_argument("--deviations", help="folder of the deviation records of bundles that were left out")
    two.add_argument("--audit-run-id", required=True)
    two.add_argument("--audited-at", required=True, help="UTC time that is written into the claims")
    three = commands.add_parser("calibrate", help="verdicts of traces against human labels")
    three.add_argument("--traces", required=True, help="folder of trace files")
    three.add_argument("--gold", required=True, help="YAML file of labels")
    three.add_argument("--config", help="YAML file of settings; thresholds are those of the rules")
    three.add_argument("--out", required=True, help="folder of the report calibration.md")
    three.add_argument("--traces-out", help="folder of the traces, written again")
    three.add_argument("--pinned-at", required=True, help="the report's time")
    return top


def _once(done: audit.Audit) -> audit.Audit:
    """The audit with its tables worked out once: several files are made of them."""
    return dataclasses.replace(done, assessments=settled(done.assessments), contexts=settled(done.contexts))


def run_audit(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    done = _once(audit.audit_drafts(spark, args.drafts, args.evidence, args.one_file))
    reports.write_markdown(done.assessments, done.contexts, args.out, done.bundles)
    said = [f"Wrote Markdown reports: {args.out}"]
    if args.json_out:
        reports.write_json(done.assessments, done.contexts, args.json_out)
        said.append(f"Wrote JSON reports: {args.json_out}")
    bare = done.bundles.agg(F.count_if(F.col("n_sources") == 0).alias("bare")).first().bare
    return [*said, *_summary(done.assessments, bare)]


def run_bundles(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    if any(path and overlaps(path, args.bundles) for path in (args.out, args.reports, args.faults, args.deviations)):
        raise ValueError("the output must not be the source or inside it")
    done = _once(audit.audit_bundles(spark, args.bundles))
    writeback.write_audited(spark, args.bundles, args.out, writeback.lexical_results(done.assessments), args.audit_run_id, args.audited_at)
    said = [f"Wrote audited bundles: {args.out}"]
    if args.reports:
        reports.write_markdown(done.assessments, done.contexts, args.reports)
        said.append(f"Wrote Markdown reports: {args.reports}")
    left = done.faults.select("bundle_id").distinct().count()
    if args.faults:
        reports.write_rows(done.faults, args.faults)
    if args.deviations:
        deviations.write_deviations(deviations.deviation_records(done.faults, args.audited_at), args.deviations)
    return [*said, f"Bundles left out for their faults: {left}", *_summary(done.assessments)]


def run_calibration(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    chosen, labels, read = settings.load_settings(args.config), gold.read_gold(spark, args.gold), traces.read_traces(spark, args.traces)
    pairs = gold.paired(labels, read)
    told = traces.verdict_rows(read)
    gold.write_calibration(gold.calibration_lines(pairs, labels.starved, told, chosen, args.pinned_at), args.out, "calibration.md")
    said = [f"Wrote calibration report: {args.out}/calibration.md"]
    if args.traces_out:
        write_named(writeback.trace_files(read, F.concat("claim_id", F.lit(".json"))), args.traces_out)
        said.append(f"Wrote traces: {args.traces_out}")
    return said


def _summary(assessments, bare: int = 0) -> list[str]:
    return [rules.audit_summary(assessments).select(adapt.summary_line(F.lit(1 - min(bare, 1))).alias("line")).first().line]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs a command and tells what was written; 1 where an input is refused."""
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("provenlake").getOrCreate()
    run = {"audit": run_audit, "audit-bundle": run_bundles, "calibrate": run_calibration}[args.command]
    try:
        print("\n".join(run(spark, args)))
    except (SourceError, ValueError, OSError, PySparkException) as wrong:
        print(f"{args.command}: {wrong}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
