"""python -m corpusloom: scan a folder, list the checks, compare two fingerprints.

Ends with 0 if nothing blocks, 1 if there is nothing to scan, 2 for wrong arguments, 10 if a
finding blocks the declared target.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import tomllib

OK, EMPTY, USAGE, BLOCKED = 0, 1, 2, 10


def _settings(root: str) -> dict:
    """[scan] and [mute] of a corpusloom.toml beside the data."""
    path = os.path.join(root, "corpusloom.toml")
    if not os.path.exists(path):
        return {}
    with open(path, "rb") as f:
        own = tomllib.load(f)
    return own.get("scan", {}) | {"mute": own.get("mute", {}).get("checks", [])}


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    scan = sub.add_parser("scan", help="scan a folder of training data")
    scan.add_argument("path")
    scan.add_argument("--out", default="corpusloom-report")
    scan.add_argument("--profile", choices=("sft", "corpus", "preference", "unknown"))
    scan.add_argument("--target", choices=("sft", "corpus", "preference"))
    scan.add_argument("--template")
    scan.add_argument("--seq-len", type=int)
    scan.add_argument("--tier", type=int, choices=(0, 1))
    scan.add_argument("--mute", action="append")
    scan.add_argument("--limit", type=int, help="records of each file")
    scan.add_argument("--benchmark", help="Parquet with item_id and text")
    scan.add_argument("--no-html", action="store_true")
    scan.add_argument("--no-evidence", action="store_true")
    scan.add_argument("--quiet", action="store_true")
    sub.add_parser("checks", help="list the checks").add_argument("check", nargs="?")
    both = sub.add_parser("compare", help="compare two fingerprint.json")
    both.add_argument("one")
    both.add_argument("other")
    sub.add_parser("version")
    return p


def scan_of(spark, root: str, own: dict):
    """The Scan of a folder. Records without a layout are texts; those with turns are conversations too."""
    from pyspark.sql import functions as F

    from corpusloom.plans.findings import Scan
    from corpusloom.sources import readers
    from corpusloom.sources.records import to_documents
    from corpusloom.workspace import Workspace

    raw = readers.read_folder(spark, root, own.get("limit"))
    work = Workspace(spark)
    raw = work.save(raw.select("dataset", "file", "place", F.coalesce("record", "error").alias("record")), "records")
    normalised = work.save(to_documents(raw), "normalised")
    seen = normalised.withColumn("doc_id", F.xxhash64("dataset", "place", "text"))
    docs = seen.select("doc_id", "dataset", "text")
    convs = seen.where(F.size("turns") > 0).select(F.col("doc_id").alias("conv_id"), "dataset", "turns", "text", "prompt", "answer")
    profile = own.get("profile") or own.get("target")
    if not profile:
        n = seen.agg(F.count("*").alias("n"), F.count_if(F.size("turns") > 0).alias("t"), F.count_if(F.col("layout") == "preference").alias("p")).first()
        profile = "unknown" if not n.n else "preference" if 2 * n.p > n.n else "sft" if 2 * n.t > n.n else "corpus"
    items = spark.read.parquet(own["benchmark"]).select(F.lit("benchmark").alias("benchmark"), "item_id", "text") if own.get("benchmark") else None
    more = {k: own[k] for k in ("template", "seq_len", "tier", "target") if own.get(k) is not None}
    scan = Scan(docs, convs, raw, readers.licences(spark, root), items, profile, muted=tuple(own.get("mute") or ()), **more)
    scan.normalised = normalised
    return scan


def run_scan(args: argparse.Namespace, spark=None) -> int:
    from corpusloom.plans import report
    from corpusloom.plans.findings import REGISTRY, without_evidence
    from corpusloom.session import local_session
    from corpusloom.sources import readers

    if not os.path.isdir(args.path) or not readers.discover(args.path):
        print(f"{args.path}: no data files", file=sys.stderr)
        return EMPTY
    given = {"profile": args.profile, "target": args.target, "template": args.template, "seq_len": args.seq_len, "tier": args.tier, "mute": args.mute, "limit": args.limit, "benchmark": args.benchmark}
    own = _settings(args.path) | {k: v for k, v in given.items() if v is not None}
    scan = scan_of(spark or local_session(), args.path, own)
    found, print_, skipped = report.ranked(scan), report.fingerprint(scan), REGISTRY.resolve(scan)[1]
    if args.no_evidence:
        found, print_ = without_evidence(found), without_evidence(print_)
    written = {"findings.jsonl": "".join(json.dumps(f, ensure_ascii=False) + "\n" for f in found), "fingerprint.json": json.dumps(print_, indent=1), "report.md": report.markdown(found, print_, skipped)}
    if not args.no_html:
        written["report.html"] = report.page(found, print_)
    os.makedirs(args.out, exist_ok=True)
    for name, text in written.items():
        with open(os.path.join(args.out, name), "w", encoding="utf-8") as f:
            f.write(text)
    if not args.quiet:
        print(report.triage(found))
    return BLOCKED if any(f["is_blocking"] for f in found) else OK


def main(argv: list[str] | None = None, spark=None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "scan":
        return run_scan(args, spark)
    if args.command == "compare":
        from corpusloom.plans.report import compare

        prints = []
        for path in (args.one, args.other):
            with open(path, encoding="utf-8") as f:
                prints.append(json.load(f))
        for row in compare(*prints):
            print(json.dumps(row))
        return OK
    if args.command == "checks":
        from corpusloom.plans.findings import REGISTRY

        for check in sorted(REGISTRY.checks.values(), key=lambda c: c.check_id):
            if args.check in (None, check.check_id):
                print(f"{check.check_id}  {check.severity:<9}{','.join(check.profiles):<34}{check.title}" + (f"\n  {check.fix}" if args.check else ""))
        return OK if args.check is None or args.check in REGISTRY.checks else USAGE
    from corpusloom.plans.report import VERSION

    print(VERSION)
    return OK


if __name__ == "__main__":
    sys.exit(main())
