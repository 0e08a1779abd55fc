"""Command line: ``serve``, ``watch PATH``, ``search PATH QUERY``, ``reindex PATH``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("lodeseek", description="Search source trees by words and vectors.")
    p.add_argument("--master", help="Spark master; the one that is configured, or all cores of this machine")
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("serve", help="answer tool calls on stdin")
    for name in ("watch", "search", "reindex"):
        c = commands.add_parser(name)
        c.add_argument("path", nargs="?" if name == "watch" else None, default=".")
        c.add_argument("--store", help="folder of the index; in the tree's state folder unless given")
        if name == "search":
            c.add_argument("query")
            c.add_argument("-k", type=int, default=10)
            c.add_argument("--rrf-k", type=int, default=60)
            c.add_argument("--bm25-weight", type=float)
            c.add_argument("--vector-weight", type=float)
            for flag in ("adaptive", "diversify", "boost-imports"):
                c.add_argument(f"--{flag}", action="store_true")
        if name == "reindex":
            c.add_argument("--force", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = vars(parser().parse_args(argv))
    command, master = args.pop("command"), args.pop("master")
    from lodeseek import service

    if spark is None:
        builder = SparkSession.builder.appName("lodeseek").config("spark.ui.showConsoleProgress", "false")
        spark = (builder.master(master) if master else builder).getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    if command == "serve":
        service.serve(spark)
    elif command == "watch":
        service.watch(spark, **args).awaitTermination()
    else:
        call = service.search_code if command == "search" else service.reindex
        print(json.dumps(call(spark, **args), ensure_ascii=False, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
