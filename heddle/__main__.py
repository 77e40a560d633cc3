"""The command line: ``python -m heddle FOLDER repo list|get KEY`` and ``refs``, ``commits``, ``diff`` over a folder of tables."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle import registry
from heddle.operators import refs, trees
from heddle.session import local_session
from heddle.sources import model


def answer(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.command == "repo":
        repos = registry.repositories(spark, args.folder)
        return refs.page(repos, "repo", args.prefix, args.token, args.limit) if args.key is None else repos.where((F.col("repo") == args.key) & ~F.col("deleted"))
    if args.command == "refs":
        return refs.list_refs(model.refs(spark, args.folder), args.prefix or [])
    if args.command == "commits":
        starts = spark.createDataFrame([(args.start,)], "start long")
        return registry.the_graph(spark, args.folder).list_commits(starts, args.limit).orderBy("place")
    return trees.in_path_order(trees.diff(*registry.snapshots(spark, args.folder)), args.limit or trees.DIFF_CHANGES)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="heddle")
    out.add_argument("folder")
    commands = out.add_subparsers(dest="command", required=True)
    repo = commands.add_parser("repo")
    repo.add_argument("action", choices=["list", "get"])
    repo.add_argument("key", nargs="?")
    repo.add_argument("--prefix", default="")
    repo.add_argument("--token")
    commands.add_parser("refs").add_argument("--prefix", action="append")
    commands.add_parser("commits").add_argument("start", type=int)
    commands.add_parser("diff")
    for name in ("repo", "commits", "diff"):
        commands.choices[name].add_argument("--limit", type=int, default=0)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "repo" and (args.action == "get") != (args.key is not None):
        print("`repo get` takes a key, `repo list` none", file=sys.stderr)
        return 2
    rows = answer(spark or local_session(), args)
    found = 0
    for row in rows.toLocalIterator():
        print("\t".join("" if x is None else str(x) for x in row))
        found += 1
    if args.command == "repo" and args.action == "get" and not found:
        print(f"no repository {args.key}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
