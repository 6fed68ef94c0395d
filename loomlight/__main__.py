"""Command line: compiling the graph, answering questions, running a test set.

    python -m loomlight build-graph SEED OUT [--reviewed FILE] [--strict]
    python -m loomlight ask SEED "question" [--source NAME ...] [--backend sql]
    python -m loomlight eval SEED CASES
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from loomlight.operators import evaluate
from loomlight.operators.graph import Graph, compile_graph, warnings
from loomlight.plans.ask import ask
from loomlight.sources import files


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="loomlight")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, more in (("build-graph", ["out"]), ("ask", ["question"]), ("eval", ["cases"])):
        one = commands.add_parser(name)
        for argument in ("seed", *more):
            one.add_argument(argument)
        one.add_argument("--reviewed")
        one.add_argument("--backend", choices=["memory", "sql"], default="memory")
    commands.choices["build-graph"].add_argument("--strict", action="store_true", help="fail if there are warnings")
    commands.choices["ask"].add_argument("--source", action="append", default=[])
    return parser


def main(arguments: list[str], spark: SparkSession | None = None) -> int:
    """0, or 1 where a strict build has warnings or a test set has failures."""
    args = _parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("loomlight").getOrCreate()
    nodes, edges = files.read_seed(spark, args.seed)
    reviewed = files.read_reviewed(spark, args.reviewed).drop("evidence_chunks") if args.reviewed else None
    graph: Graph = compile_graph(nodes, edges, reviewed)
    if args.command == "build-graph":
        found = warnings(nodes, edges, reviewed, graph)
        lines = [f"{r['kind']}: {r['key']}" for r in found.orderBy("kind", "key").limit(100).collect()]
        print("\n".join(lines) or "no warnings")
        if lines and args.strict:
            return 1
        files.write_graph(graph, args.out)
        return 0
    if args.command == "ask":
        questions = spark.createDataFrame([(0, args.question, args.source)], "qid long, question string, sources array<string>")
        rows = ask(questions, graph, backend=args.backend).collect()
        for r in rows:
            print(r["answer"])
            print("\n".join(f"  [{c['work']}] {c['locator']}" for c in r["citations"]))
        return 0 if rows else 1
    checked, totals = evaluate.run(files.read_cases(spark, args.cases), lambda q: ask(q, graph, backend=args.backend))
    for r in checked.orderBy("id", "name").limit(1000).collect():
        print(f"{str(r['id']):<12}{r['name']:<28}{'skipped' if r['pass'] is None else 'passed' if r['pass'] else 'failed'}")
    total = totals.collect()[0]
    print(f"{total['passed']} passed, {total['failed']} failed, {total['skipped']} skipped")
    return 1 if total["failed"] else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
