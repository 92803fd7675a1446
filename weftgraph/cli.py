"""weftgraph run | validate | dry-run CONFIG."""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

from weftgraph import __version__
from weftgraph.config import load_config
from weftgraph.plans.csv_mapping import load_csv_mapping


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("weftgraph", description="Build property graphs from tabular and JSON data on Spark.")
    p.add_argument("--version", action="version", version=__version__)
    commands = p.add_subparsers(dest="command", required=True)
    for name, about in (("run", "run a job"), ("validate", "check a configuration"), ("dry-run", "read sources and apply validation only")):
        c = commands.add_parser(name, help=about)
        c.add_argument("config")
        c.add_argument("--log-level", default="INFO", type=str.upper, choices=["DEBUG", "INFO", "WARNING", "ERROR"])
        if name == "run":
            c.add_argument("--metrics-output", help="where to write metrics as JSON")
            c.add_argument("--mapping-csv", help="a mapping sheet that replaces the job's nodes and relationships")
    return p


def _run(args: argparse.Namespace) -> None:
    from weftgraph.plans.engine import run

    cfg = load_config(args.config)
    if args.mapping_csv:
        cfg = load_csv_mapping(args.mapping_csv, sources=[s.model_dump() for s in cfg.sources], connection=cfg.connection.model_dump(), settings=cfg.settings.model_dump())
    out = run(cfg, config_path=args.config)
    print("Job complete")
    for kind, found in (("Nodes", out.nodes_created), ("Rels", out.relationships_created)):
        for name, n in found.items():
            print(f"  {kind} [{name}]: {n}")
    if out.records_skipped:
        print(f"  Skipped: {out.records_skipped} records")
    if args.metrics_output:
        Path(args.metrics_output).write_text(out.metrics.to_json(), encoding="utf-8")


def _validate(args: argparse.Namespace) -> None:
    cfg = load_config(args.config)
    schema = cfg.graph_schema
    counts = {"Sources": len(cfg.sources), "Node mappings": len(cfg.nodes), "Relationship mappings": len(cfg.relationships)}
    counts |= {"Constraints": len(schema.constraints), "Indexes": len(schema.indexes)} if schema else {}
    counts |= {"Generated ids": sum(n.id_generation is not None for n in cfg.nodes), "Pre-hooks": len(cfg.pre_hooks), "Post-hooks": len(cfg.post_hooks)}
    print("Configuration is valid")
    for k, v in counts.items():
        print(f"  {k}: {v}")


def _dry_run(args: argparse.Namespace) -> None:
    from weftgraph.plans.engine import run_from_file

    out = run_from_file(args.config, dry_run=True)
    print("Dry run complete; nothing was written")
    for s in out.metrics.steps:
        print(f"  {s.name}: {s.records_processed} records" + (f", {s.records_failed} failed" if s.records_failed else ""))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=args.log_level, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    try:
        {"run": _run, "validate": _validate, "dry-run": _dry_run}[args.command](args)
    except Exception as e:  # a command reports any error and ends with 1
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0
