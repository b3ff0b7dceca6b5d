"""python -m palimpsest.plans.cli COMMAND: nine subcommands over a workspace folder."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import overlay, stats
from palimpsest.plans import commands
from palimpsest.sources.store import load_tables


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="palimpsest", description="Transcript corrections as an overlay, queried with Spark.")
    sub = parser.add_subparsers(dest="command", required=True)

    def add(name: str, help_: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=help_)
        p.add_argument("root", help="workspace folder")
        p.add_argument("--source", help="id of a source, or part of its title")
        p.add_argument("--out", help="write JSON lines to this folder instead of printing them")
        return p

    p = add("run", "start a correction run and summarise every source")
    p.add_argument("--prune", action="store_true", help="prune empty segments")
    p.add_argument("--purpose")
    p.add_argument("--test", action="store_const", const="feature-test", dest="purpose", help="a session that is no genuine work")
    p.add_argument("--manifest", help="write a run manifest here")
    p = add("review", "the review sheet of a session")
    p.add_argument("--session", required=True)
    p.add_argument("--decisions", help="JSON lines of segment_id, decision, new_text to apply first")
    p.add_argument("--max-items", type=int, default=0)
    p = add("stats", "what the overlay holds")
    p.add_argument("--genuine-only", action="store_true")
    p.add_argument("--label", help="inserts and marks of one label")
    p = add("gate", "show gates, or assert one")
    p.add_argument("--assert", dest="status", choices=("in_progress", "signed_off", "excluded"))
    p.add_argument("--through", help="seconds, or 'end'")
    p.add_argument("--skeleton")
    p = add("extract", "write the gated dataset")
    p.add_argument("--to", required=True, help="folder of the dataset")
    p.add_argument("--rendition")
    p.add_argument("--include-purpose", action="append")
    p = add("bench", "verdicts on a source's proposals")
    p.add_argument("--skeleton")
    p.add_argument("--tolerance", type=float, default=0.15)
    p.add_argument("--include-purpose", action="append")
    p = add("transfer-wordless", "move event inserts to another spine")
    p.add_argument("--from-skeleton", required=True)
    p.add_argument("--to-skeleton", required=True)
    p.add_argument("--labels", nargs="*")
    p.add_argument("--tolerance", type=float, default=0.15)
    p.add_argument("--dry-run", action="store_true")
    p = add("export-wordless-propset", "event inserts as a proposal set")
    p.add_argument("--skeleton")
    p.add_argument("--labels", nargs="*")
    p = add("scan-mishomed", "aligned words outside their chunk")
    p.add_argument("--rendition")
    p.add_argument("--skeleton")
    p.add_argument("--min-overlap", type=float, default=0.05)
    p.add_argument("--strict", action="store_true", help="exit 1 if there are some")
    return parser


def main(argv: list[str] | None = None) -> int:
    a = build_parser().parse_args(argv)
    spark = SparkSession.builder.appName("palimpsest").getOrCreate()
    if a.command == "run":
        commands.write_json(commands.run(spark, a.root, a.source, a.prune, purpose=a.purpose, manifest_to=a.manifest), a.out)
    elif a.command == "review":
        decisions = spark.read.schema("segment_id string, decision string, new_text string").json(a.decisions) if a.decisions else None
        commands.write_json(commands.review(spark, a.root, a.session, decisions, a.max_items), a.out)
    elif a.command == "stats":
        t = load_tables(spark, a.root)
        dead = commands.superseded_of(t)
        if a.label:
            commands.write_json(stats.label_spotlight(t["correction"], dead, a.label), a.out)
        else:
            commands.write_json(stats.stats_by_purpose(t["correction"], dead, overlay.latest_rows(t["session"]), ["genuine"] if a.genuine_only else None), a.out)
    elif a.command == "gate":
        if a.status:
            print(json.dumps(commands.assert_gate(spark, a.root, a.source, a.status, a.through, a.skeleton)))
        else:
            t = load_tables(spark, a.root)
            table = commands.gate_table(t["segment"], t["gate"])
            commands.write_json(table.where(F.col("source_id") == a.source) if a.source else table, a.out)
    elif a.command == "extract":
        print(json.dumps(commands.extract(spark, a.root, a.to, a.source, a.include_purpose, a.rendition), indent=2))
    elif a.command == "bench":
        commands.write_json(commands.bench(spark, a.root, a.source, a.skeleton, a.include_purpose, a.tolerance).verdicts, a.out)
    elif a.command == "transfer-wordless":
        commands.write_json(commands.transfer_wordless(spark, a.root, a.source, a.from_skeleton, a.to_skeleton, a.labels, a.tolerance, not a.dry_run), a.out)
    elif a.command == "export-wordless-propset":
        print(json.dumps(commands.export_proposals(spark, a.root, a.source, a.skeleton, a.labels), indent=2))
    else:
        found = commands.scan_mishomed(spark, a.root, a.source, a.rendition, a.skeleton, a.min_overlap)
        commands.write_json(found, a.out)
        return int(a.strict and not found.isEmpty())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
