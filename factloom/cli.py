"""Command line over snapshots of a program's graph: callees, flow and diff. Nodes are node, label; edges are src, dst.

    python -m factloom.cli callees --root FOLDER FUNCTION
    python -m factloom.cli flow --root FOLDER [--max-depth N] [--max-nodes N] [--max-paths N] FROM TO
    python -m factloom.cli diff --root FOLDER OLD-VERSION NEW-VERSION
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from factloom.operators import graph, summary
from factloom.sources.store import Snapshots


def _size(text: str) -> int:
    if not text.isascii() or not text.isdigit():
        raise argparse.ArgumentTypeError(f"no size: {text}")
    return int(text)


def _arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="factloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, names in {"callees": ["function"], "flow": ["start", "end"], "diff": ["old", "new"]}.items():
        command = commands.add_parser(name)
        command.add_argument("--root", required=True)
        for positional in names:
            command.add_argument(positional)
    flow = commands.choices["flow"]
    for budget, default in {"--max-depth": 10, "--max-nodes": 1000, "--max-paths": 1000}.items():
        flow.add_argument(budget, type=_size, default=default)
    return parser.parse_args(argv)


def answers(spark: SparkSession, argv: list[str]) -> Iterator[str]:
    """The lines of a command's answer."""
    a = _arguments(argv)
    held = Snapshots(spark, a.root)
    if a.command == "callees":
        rows = graph.callees(held.read("edges"), a.function).join(held.read("nodes"), "node").orderBy("node")
        yield from (f"{r['node']} {r['label']}" for r in rows.select("node", "label").toLocalIterator())
    elif a.command == "flow":
        found = graph.shortest_path(held.read("edges"), a.start, a.end, a.max_depth, a.max_nodes, a.max_paths)
        yield from found["path"] or ["no path"]
        if found["truncated"]:
            yield "truncated: " + ", ".join(found["reasons"])
    else:
        changes = summary.changed(held.read("digests", a.old), held.read("digests", a.new)).orderBy("function", "component")
        line = F.concat_ws(" ", *[F.col(c).cast("string") for c in changes.columns])
        yield from (r[0] for r in changes.select(line).toLocalIterator())


def main(argv: list[str] | None = None) -> int:
    spark = SparkSession.builder.getOrCreate()
    try:
        for line in answers(spark, sys.argv[1:] if argv is None else argv):
            print(line)
    except (LookupError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
