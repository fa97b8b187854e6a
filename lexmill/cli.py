"""Command line: ``python -m lexmill.cli index build|query|bench``."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import TextOptions
from lexmill.operators import search, setops
from lexmill.operators.index import build_index
from lexmill.plans.query import QueryError, parse
from lexmill.plans.rewrite import load_synonyms
from lexmill.sources import store
from lexmill.sources.corpus import read_corpus, synthetic


def session(threads: int = 0) -> SparkSession:
    return SparkSession.builder.master(f"local[{threads or '*'}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def percentile(values: list[float], p: float) -> float:
    """Linear interpolation between the values around place ``p * (n - 1)``; 0 for none."""
    if not values:
        return 0.0
    values = sorted(values)
    at = p * (len(values) - 1)
    low = int(at)
    return values[low] + (at - low) * (values[min(low + 1, len(values) - 1)] - values[low])


def rss_bytes() -> int:
    """Resident memory of this process and of the JVM that it started, where the system tells; else 0."""
    pids, total = ["self"], 0
    try:
        with open(f"/proc/self/task/{os.getpid()}/children") as file:
            pids += file.read().split()
        for pid in pids:
            with open(f"/proc/{pid}/status") as file:
                total += sum(1024 * int(x.split()[1]) for x in file if x.startswith("VmRSS:"))
    except (OSError, ValueError):
        return total
    return total


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexmill")
    commands = top.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index").add_subparsers(dest="action", required=True).add_parser("build")
    index.add_argument("folder")
    index.add_argument("-o", dest="out", required=True)
    index.add_argument("--threads", type=int, default=0)
    query = commands.add_parser("query")
    query.add_argument("index")
    query.add_argument("query")
    query.add_argument("--mode", default="boolean")
    query.add_argument("--topk", type=int, default=10)
    query.add_argument("--intersect", default="gallop")
    query.add_argument("--synonyms", default="")
    query.add_argument("--mmap", action="store_true", help="accepted; stored tables are always read column by column")
    for p in (index, query):
        p.add_argument("--stem", action="store_true")
        p.add_argument("--stopwords", action="store_true")
    bench = commands.add_parser("bench")
    bench.add_argument("--docs", type=int, default=5000)
    bench.add_argument("--seed", type=int, default=42)
    bench.add_argument("--out", default="")
    return top


def run_query(spark: SparkSession, args: argparse.Namespace) -> int:
    """Exit codes: 0 also without results, 1 for an index or a query that cannot be read, 2 for usage."""
    try:
        index = store.load_index(spark, args.index)
    except store.IndexError_:
        print(f"Failed to load index: {args.index}", file=sys.stderr)
        return 1
    if args.stem or args.stopwords:
        index.options = TextOptions(args.stopwords, args.stem)
    try:
        node = parse(args.query, index.options)
    except QueryError as error:
        print(error, file=sys.stderr)
        return 1
    node = search.as_tree(index, node, load_synonyms(args.synonyms) if args.synonyms else None)
    if args.mode == "boolean":
        hits = search.boolean(index, node) if args.intersect == "gallop" else search.boolean_by_sets(index, node, args.intersect)
        lines = [r["path"] for r in search.with_paths(index, hits).orderBy("doc_id").toLocalIterator()]
    elif args.mode == "bm25":
        found = search.with_paths(index, search.bm25(index, node, args.topk)).orderBy(F.desc("score"), F.desc("doc_id")).collect()
        lines = [f"{r['score']:g}\t{r['path']}" for r in found]
    else:
        print(f"Unknown mode: {args.mode}", file=sys.stderr)
        return 2
    print("\n".join(lines) if lines else "No results")
    return 0


def run_bench(spark: SparkSession, docs: int, seed: int, out: str) -> int:
    began = time.time()
    index = build_index(synthetic(spark, docs, seed), path_col="path")
    for frame in (index.docs, index.postings, index.term_stats):
        frame.cache().count()
    built = time.time() - began
    took = []
    for query in ("river stone", "lamp AND window", "paper OR garden", "copper signal"):
        for _ in range(3):
            at = time.time()
            search.rank_terms(index, query.replace(" AND", "").replace(" OR", "").split()).collect()
            took.append(time.time() - at)
    ids = spark.range(50_000).select(F.col("id").alias("doc_id")).cache()
    few = ids.where("doc_id % 997 = 0").cache()
    ids.count(), few.count()
    meet = {}
    for mode, intersect in setops.INTERSECT.items():
        for _ in range(3):
            at = time.time()
            intersect(few, ids).count()
            meet.setdefault(mode, []).append(time.time() - at)
    lines = "".join(f"| intersection p50, p95 seconds ({mode}) | {percentile(t, 0.5):.3f}, {percentile(t, 0.95):.3f} |\n" for mode, t in meet.items())
    report = f"| metric | value |\n| --- | --- |\n| documents | {docs} |\n| build seconds | {built:.3f} |\n| ranked query p50 seconds | {percentile(took, 0.5):.3f} |\n| ranked query p95 seconds | {percentile(took, 0.95):.3f} |\n{lines}| resident bytes | {rss_bytes()} |\n"
    print(report, end="")
    if out:
        with open(out, "w", encoding="utf-8") as file:
            file.write(report)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = _parser().parse_args(argv)
    except SystemExit as stop:
        return 2 if stop.code else 0
    spark = spark or session(getattr(args, "threads", 0))
    if args.command == "query":
        return run_query(spark, args)
    if args.command == "bench":
        return run_bench(spark, args.docs, args.seed, args.out)
    try:
        index = build_index(read_corpus(spark, args.folder), TextOptions(args.stopwords, args.stem), path_col="path")
        store.save_index(index, args.out)
    except Exception as error:
        print(f"Failed to write index: {args.out} ({error})", file=sys.stderr)
        return 1
    print(f"Indexed {index.stats()[0]} documents")
    return 0


if __name__ == "__main__":
    sys.exit(main())
