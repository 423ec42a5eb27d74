"""Command line: scan, files, git, audit, passes."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _names(text: str | None) -> list[str] | None:
    return [s for x in text.split(",") if (s := x.strip())] if text else None


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="samewise", description="Find and prove redundancy in text corpora.")
    commands = parser.add_subparsers(dest="command", required=True)
    scan = commands.add_parser("scan", help="count what 'files' would read, without reading it")
    files = commands.add_parser("files", help="exact duplicates, containment and similar clusters of a directory")
    branches = commands.add_parser("git", help="triage files that several branches changed")
    audit = commands.add_parser("audit", help="re-derive every claim of a files report from a directory")
    commands.add_parser("passes", help="list the layers in order")
    for p in (scan, files, audit):
        p.add_argument("--dir", required=True)
    for p in (scan, files):
        p.add_argument("--ignore-dirs")
    files.add_argument("--threshold", type=float, default=0.65)
    files.add_argument("--no-gitignore", action="store_true")
    files.add_argument("--max-files", default="5000", help="a number, or false")
    files.add_argument("--normalize", action="store_true")
    files.add_argument("--min-subset-lines", type=int, default=5)
    files.add_argument("--max-size-ratio", type=float, default=20.0)
    files.add_argument("--out", default="samewise-files-report.json")
    files.add_argument("--sections", help="write the report as tables into this folder, not as one document")
    branches.add_argument("--repo", required=True)
    for name in ("--base", "--branches", "--exclude"):
        branches.add_argument(name)
    branches.add_argument("--remote", default="origin")
    branches.add_argument("--no-fetch", action="store_true")
    branches.add_argument("--out", default="samewise-git-report.json")
    audit.add_argument("--report", required=True)
    return parser


def _scan(spark: SparkSession, a: argparse.Namespace) -> int:
    from .sources.files import MAX_FILES, count_files, scope

    at = time.monotonic()
    ignore = set(names) if (names := _names(a.ignore_dirs)) else None
    rows = count_files(spark, a.dir, ignore=ignore).orderBy("extension").collect()
    n, size = sum(r["files"] for r in rows), sum(r["bytes"] for r in rows)
    print(f"{n} files, {size / 2**20:.2f} MB, scanned in {(time.monotonic() - at) * 1000:.0f} ms (no content read).")
    print("By extension: " + json.dumps({r["extension"]: r["files"] for r in rows}))
    print("Directories passed over: " + ", ".join(sorted(scope(a.dir, ignore, True))))
    if n > MAX_FILES:
        print(f"Note: 'files' stops at {MAX_FILES} files unless --max-files says otherwise.")
    return 0


def _files(spark: SparkSession, a: argparse.Namespace) -> int:
    from .plans.files_plan import funnel, report, run_files, sections
    from .sources.files import load_records
    from .sources.report import write_report, write_sections

    cap = None if a.max_files == "false" else int(a.max_files)
    ignore = set(names) if (names := _names(a.ignore_dirs)) else None
    records = load_records(spark, a.dir, ignore=ignore, respect_gitignore=not a.no_gitignore, max_files=cap)
    result = run_files(records, a.normalize, a.threshold, a.min_subset_lines, a.max_size_ratio)
    if a.sections:  # nothing but the funnel comes to the driver
        write_sections(sections(result), a.sections)
        print("Funnel: " + " -> ".join(f"{s['stage']}({s['records_out']})" for s in funnel(result).collect()))
        print(f"Report as tables: {a.sections}")
        return 0
    r = report(result)
    print(f"{r['totalFiles']} files, {len(r['exactDuplicateGroups'])} groups of exact duplicates ({r['totalFiles'] - r['afterExactDedupe']} redundant copies), {len(r['containmentPairs'])} containment pairs; {r['afterContainment']} files remain.")
    print(f"{len(r['similarityClusters'])} similarity clusters among those (threshold {a.threshold}).")
    print("Timing: " + ", ".join(f"{k[:-3]} {v} ms" for k, v in r["timings"].items()))
    print("Funnel: " + " -> ".join(f"{s['stage']}({'-' if s['records_in'] is None else s['records_in']}->{s['records_out']})" for s in r["funnel"]))
    write_report(r, a.out)
    print(f"Full report: {a.out}")
    return 0


def _git(spark: SparkSession, a: argparse.Namespace) -> int:
    from .plans.git_plan import report, run_git
    from .sources.report import write_report

    if not a.base:
        print("No --base given: guessing the target of the remote's HEAD, which often isn't the branch that work is merged to.")
    r = report(run_git(spark, a.repo, a.remote, a.base, _names(a.branches), tuple(_names(a.exclude) or ()), not a.no_fetch))
    s = r["summary"]
    print(f"Base: {r['baseRef']} ({(r['baseCommit'] or '')[:8]})")
    print(f"{len(r['branchesScanned'])} branches with content ({len(r['branchesSkipped'])} disconnected, skipped); {r['totalFilesTouched']} files touched, {r['totalContended']} contended.")
    print(f"{s['redundant']} redundant, {s['auto_mergeable']} auto-mergeable, {s['needs_variant']} need variants.")
    for path, f in r["files"].items():
        if f["verdict"] == "needs_variant":
            print(f"  - {path}  ({', '.join(f['branches'])})")
    write_report(r, a.out)
    print(f"Full report: {a.out}")
    return 0


def _audit(spark: SparkSession, a: argparse.Namespace) -> int:
    from .operators import audit as A
    from .sources.files import load_records
    from .sources.report import read_report

    groups, pairs, normalized, complete = read_report(spark, a.report)
    contents = load_records(spark, a.dir, max_files=None)
    if normalized:
        contents = contents.select("id", A.normalized_again(F.col("content")).alias("content"))
    failures = A.audit(groups, pairs, contents, complete)
    print(f"Re-checked {A.claims_checked(groups, pairs, contents, complete)} claims against fresh reads, by code of its own.")
    if not complete:
        print("The report lists no files, so missed duplicates weren't looked for.")
    found = failures.orderBy("type", "a", "b").toLocalIterator()
    n = 0
    for n, f in enumerate(found, 1):
        print("  " + json.dumps(f.asDict()))
    print(f"FAIL: {n} claims did not hold" if n else "PASS: nothing would be lost")
    return int(n > 0)


def _passes(spark: SparkSession, a: argparse.Namespace) -> int:
    from .plans.files_plan import passes

    for p in passes(spark).collect():
        print(f"[depth {p['depth']}] {p['id']}: {p['technique']} ({p['certainty']}; {p['implemented_in']})")
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = _parser().parse_args(argv)
    except SystemExit as stop:  # a missing or unknown argument exits with 1, help with 0
        return int(bool(stop.code))
    spark = spark or SparkSession.builder.appName("samewise").getOrCreate()
    return {"scan": _scan, "files": _files, "git": _git, "audit": _audit, "passes": _passes}[a.command](spark, a)


if __name__ == "__main__":
    sys.exit(main())
