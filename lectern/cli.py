"""Command line: ingest, search, research, outline, read, related, evaluate, doctor."""

from __future__ import annotations

import argparse
import json
import sys
from functools import reduce

from pyspark.sql import DataFrame

from lectern.config import MODES, PIPELINES, Settings, load_settings
from lectern.operators import evaluation, quality
from lectern.plans.corpus import Corpus, envelope, snapshot_checks
from lectern.plans.index import Index
from lectern.plans.ingest import ingest
from lectern.session import get_session
from lectern.sources import files


def _show(result: dict) -> int:
    if not result["ok"]:
        print(json.dumps(result), file=sys.stderr)
        return 2
    for row in result["rows"].toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lectern")
    top.add_argument("--index", required=True, help="folder of the snapshots")
    top.add_argument("--revision", type=int, required=True)
    top.add_argument("--settings", help="TOML file")
    commands = top.add_subparsers(dest="command", required=True)
    run = commands.add_parser("ingest")
    run.add_argument("root")
    run.add_argument("--catalog")
    run.add_argument("--previous", type=int)
    search = commands.add_parser("search")
    search.add_argument("query")
    search.add_argument("--mode", choices=MODES, default="precision")
    search.add_argument("--pipeline", choices=PIPELINES, default="hybrid_rerank")
    search.add_argument("--top-k", type=int, default=10)
    research = commands.add_parser("research")
    research.add_argument("query")
    research.add_argument("--top-k", type=int, default=12)
    for name in ("outline", "related"):
        commands.add_parser(name).add_argument("paper_id")
    read = commands.add_parser("read")
    read.add_argument("paper_id")
    read.add_argument("section", type=int)
    read.add_argument("--offset", type=int, default=0)
    read.add_argument("--max-tokens", type=int, default=8000)
    commands.add_parser("evaluate").add_argument("queries", help="JSON file")
    commands.add_parser("doctor")
    return top


def main(argv=None) -> int:
    args = parser().parse_args(argv)
    settings = load_settings(args.settings) if args.settings else Settings()
    spark = get_session()

    def opened(revision):
        return Index.open(spark, args.index, revision)

    if args.command == "ingest":
        previous = opened(args.previous) if args.previous is not None else None
        return _show(envelope(lambda: ingest(spark, args.root, args.catalog, args.index, args.revision, settings, previous)[1]))
    corpus = Corpus(opened(args.revision))
    if args.command == "search":
        return _show(envelope(corpus.search_papers, args.query, args.mode, args.top_k, args.pipeline))
    if args.command == "research":
        return _show(envelope(corpus.research_search, args.query, args.top_k))
    if args.command == "outline":
        return _show(envelope(corpus.paper_outline, args.paper_id))
    if args.command == "related":
        return _show(envelope(corpus.related_papers, args.paper_id))
    if args.command == "read":
        return _show(envelope(corpus.read_section, args.paper_id, args.section, args.offset, args.max_tokens))
    if args.command == "evaluate":
        rows = files.evaluation_queries(spark, args.queries)
        from pyspark.sql import functions as F

        relevant = rows.select("query_id", F.explode("relevant_papers").alias("paper_id"))

        def evaluated():
            unknown = rows.where(~F.col("mode").isin(list(MODES))).select("mode").first()
            if unknown is not None:
                raise ValueError(f"mode must be one of {sorted(MODES)}")
            parts = []
            for mode in MODES:
                queries = rows.where(F.col("mode") == mode).select("query_id", "text", F.lit(None).cast("string").alias("scope"))
                if not queries.isEmpty():
                    parts.append(corpus.evaluate(queries, relevant, mode=mode))
            return evaluation.mean_metrics(reduce(DataFrame.unionByName, parts))

        return _show(envelope(evaluated))
    return _show(envelope(lambda: quality.readiness(snapshot_checks(corpus.index))))


if __name__ == "__main__":
    sys.exit(main())
