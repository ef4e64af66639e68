"""Command line: ``python -m tracewright scan|report|fp-report|fix ...``.

Exit status of a scan: 0 nothing found, 1 findings, 2 wrong usage.
"""

from __future__ import annotations

import argparse
import os
import sys
import time
import uuid
from datetime import date

from pyspark.sql import functions as F


def _arguments(argv):
    parser = argparse.ArgumentParser(prog="tracewright")
    commands = parser.add_subparsers(dest="command", required=True)
    scan = commands.add_parser("scan", help="scan repositories")
    scan.add_argument("path", nargs="*", help="repository folders")
    scan.add_argument("--config", help="YAML file listing repositories")
    scan.add_argument("--output", help="folder for all findings")
    scan.add_argument("--format", choices=("json", "csv", "sarif", "payload"), default="json",
                      help="payload: one document in parts, of one repository or with a list for each")
    scan.add_argument("--limit", type=int, default=50, help="rows to print")
    scan.add_argument("--rule", action="append", help="only this rule")
    scan.add_argument("--fp-log")
    scan.add_argument("--diff", metavar="REF", help="only files changed since REF in their repository")
    scan.add_argument("--baseline")
    scan.add_argument("--generate-baseline", metavar="PATH")
    scan.add_argument("--ledger", help="ledger table that gets the new findings, as a new version")
    scan.add_argument("--ledger-version", type=int, help="refuse to write if the ledger has a newer version than this")
    scan.add_argument("--ledger-files", help="folder that gets a YAML file per new finding")
    scan.add_argument("--modules", help="folder of modules parsed by earlier scans; only new contents are parsed")
    scan.add_argument("--records", help="folder of the tables of scans and findings, which this scan is added to")
    for name, text in (("report", "track record"), ("fp-report", "false-positive rates")):
        commands.add_parser(name, help=text).add_argument("ledger")
    fix = commands.add_parser("fix", help="preview fixes as diffs")
    fix.add_argument("path")
    fix.add_argument("--rule")
    fix.add_argument("--finding-id")
    fix.add_argument("--output", required=True, help="folder for the patches")
    return parser.parse_args(argv)


def main(argv=None) -> int:
    args = _arguments(argv)
    from .session import spark_session

    spark = spark_session("tracewright")
    return {"scan": _scan, "report": _report, "fp-report": _fp_report, "fix": _fix}[args.command](spark, args)


def _scan(spark, args) -> int:
    from . import config, scan_multi, sinks
    from .session import materialise, work_tables
    from .sources.parsed import ParsedModules

    named = [(os.path.basename(os.path.abspath(p)), p) for p in args.path]
    if args.config:
        named += config.load_scan_config(args.config).folders().items()
    repos = dict(named)
    if len(repos) < len(named):
        print("two repositories have one name; give them ids in a --config file", file=sys.stderr)
        return 2
    if not repos or not all(os.path.exists(p) for p in repos.values()):
        print("nothing to scan", file=sys.stderr)
        return 2
    options = {"rules": args.rule}
    if args.diff:
        options["changed"] = config.changed_in(spark, repos, args.diff)
    if args.baseline:
        options["baseline"] = sinks.read_baseline(spark, args.baseline)
    if args.modules:
        options["modules"] = ParsedModules(spark, args.modules)
    with work_tables(spark):
        started = time.time()
        found = materialise(scan_multi(spark, repos, fp_log=args.fp_log, **options), "findings")
        if args.records:
            _record(spark, args, repos, found, started)
        return _found(args, sorted(repos), found)


def _record(spark, args, repos, found, started) -> None:
    """The scan of each repository and its findings, as rows of the stored tables."""
    from .operators import records as rc

    store, number = rc.open_records(spark, args.records), uuid.uuid4().hex[:12]
    scans = spark.createDataFrame([(f"{number}-{name}", name, os.path.abspath(path), started) for name, path in repos.items()],
                                  "scan_id string, repo string, repo_path string, started_at double")
    rc.start_scans(store, scans.drop("repo"))
    rc.record_findings(store, rc.finding_rows(found, F.concat(F.lit(f"{number}-"), "repo"), time.time()))
    rc.finish_scans(store, scans.select("scan_id", F.lit(time.time()).alias("finished_at"), F.lit("done").alias("status")))


def _found(args, repos, found) -> int:
    from . import sinks
    from .tables import StaleVersion
    from .operators.findings import by_severity
    from .operators.ledger import ledger_rows

    for row in found.orderBy(*by_severity()).limit(args.limit).collect():
        print(f"{row.severity.score:6.1f} {row.rule_id} {row.repo}/{row.file}:{row.line} {row.function}  {row.evidence}")
    if args.output and args.format == "payload":
        if len(repos) > 1:
            sinks.write_payload_by_repo(found, repos, args.output)
        else:
            sinks.write_payload({"candidates": found}, args.output)
    elif args.output:
        {"json": sinks.write_json, "csv": sinks.write_csv, "sarif": sinks.write_sarif}[args.format](found, args.output)
    if args.generate_baseline:
        sinks.write_baseline(found, args.generate_baseline)
    rows = ledger_rows(found, date.today().isoformat())
    if args.ledger_files:
        sinks.write_ledger_folder(rows, args.ledger_files)
    if args.ledger:
        try:
            print(f"ledger version {sinks.write_ledger(rows, args.ledger, args.ledger_version)}")
        except StaleVersion as problem:
            print(problem, file=sys.stderr)
            return 2
    return 0 if found.isEmpty() else 1


def _report(spark, args) -> int:
    from .operators.reports import in_order, track_record
    from .session import materialise
    from .sinks import read_ledger

    ledger = materialise(read_ledger(spark, args.ledger), "ledger")
    for row in in_order(track_record(ledger)).toLocalIterator():
        print(row.line)
    return 0


def _fp_report(spark, args) -> int:
    from .operators.reports import fp_rates
    from .sinks import read_ledger

    for row in fp_rates(read_ledger(spark, args.ledger)).orderBy(F.col("fp_rate_exact").desc()).collect():
        print(f"{row.rule_id}@{row.rule_version:<12} {row.attempts:>8} {row.fp_rate:>6} {'review' if row.needs_logic_review else ''}")
    return 0


def _fix(spark, args) -> int:
    from . import scan
    from .operators.fixes import fix_previews
    from .session import work_tables
    from .sources.files import list_files, python_files

    with work_tables(spark):
        found = scan(spark, args.path, rules=[args.rule] if args.rule else None)
        if args.finding_id:
            found = found.where(F.col("id") == args.finding_id)
        names = python_files(list_files(spark, {"local": args.path}))
        fix_previews(found, names).write.mode("overwrite").json(args.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
