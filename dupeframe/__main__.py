"""Job entry: ``scan`` finds duplicates, ``reclaim`` acts on a report.

    python -m dupeframe scan -i /data/a -i /data/b -e /data/a/tmp -o report.json
    python -m dupeframe reclaim --report report.json --rule oldest --quarantine /data/.trash
"""

from __future__ import annotations

import argparse
import sys

from dupeframe.functions.fingerprint import NATIVE, STREAMED
from dupeframe.operators.reclaim import moved_totals
from dupeframe.operators.validate import UnsafeSelection
from dupeframe.plans.reclaim import plan_reclaim
from dupeframe.plans.scan import scan_tree
from dupeframe.session import build_session
from dupeframe.sources.actions import read_actions
from dupeframe.sources.report import check_report_paths, read_report
from dupeframe.sources.tree import stat_paths
from dupeframe.staging import drop_stages


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="dupeframe")
    jobs = parser.add_subparsers(dest="job", required=True)
    scan = jobs.add_parser("scan", help="find files of equal content")
    scan.add_argument("-i", "--include", action="append", required=True)
    scan.add_argument("-e", "--exclude", action="append", default=[])
    scan.add_argument("-o", "--output", action="append", default=[])
    scan.add_argument("--store", help="folder of the fingerprint store")
    scan.add_argument("--algorithm", choices=STREAMED + NATIVE, default="xxh3")
    form = scan.add_mutually_exclusive_group()
    form.add_argument("--single-file", action="store_true", help="write each report as one file (as by default)")
    form.add_argument("--folder", action="store_true", help="write each report as a folder of parts")
    scan.add_argument("--progress", action="store_true", help="tell on the error stream how many files are read")
    reclaim = jobs.add_parser("reclaim", help="move all but one file per group aside")
    reclaim.add_argument("--report", required=True)
    reclaim.add_argument("--rule", choices=("first", "oldest", "newest", "shortest", "longest"))
    reclaim.add_argument("--choices", help="CSV of hash,choice")
    reclaim.add_argument("--edits", help="CSV of seq,hash,action,path")
    reclaim.add_argument("--actions", help="JSON action payload")
    reclaim.add_argument("--quarantine", required=True)
    reclaim.add_argument("--yes", action="store_true", help="move files; without it only plan")
    return parser


def _scan(spark, args) -> None:
    def tell(progress):
        print(f"read {progress.files} of {progress.total} files", file=sys.stderr)

    result = scan_tree(
        spark, args.include, args.exclude, args.algorithm, args.store,
        on_progress=tell if args.progress else None,
    )
    result.write(args.output, not args.folder)
    print(f"{result.total_files} files, {result.duplicate_groups} duplicate groups, "
          f"{result.elapsed_seconds:.2f} s")
    if args.store and result.total_files:
        print(f"store: {result.cache_hits} hits of {result.total_files} ({result.hit_rate:.1f}%)")


def _reclaim(spark, args) -> None:
    def csv(path, schema):
        return spark.read.schema(schema).csv(path, header=True) if path else None

    members = read_report(spark, args.report).members
    planned = plan_reclaim(
        members, stat_paths(members.repartition("path")),
        rule=args.rule,
        edits=csv(args.edits, "seq long, hash string, action string, path string"),
        choices=csv(args.choices, "hash string, choice string"),
        selection=read_actions(spark, args.actions) if args.actions else None,
    )
    totals = planned.totals().first()
    print(f"{totals['n_marked']} files marked, {totals['bytes']} bytes to free")
    moved = moved_totals(planned.execute(args.quarantine, dry_run=not args.yes)).first()
    print(f"{moved['count']} files moved, {moved['reclaimed_bytes']} bytes freed")


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.job == "scan":
        try:
            check_report_paths(args.output)
        except ValueError as error:
            _parser().error(str(error))
    spark = build_session()
    try:
        (_scan if args.job == "scan" else _reclaim)(spark, args)
    except (RuntimeError, UnsafeSelection) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    finally:
        drop_stages(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
