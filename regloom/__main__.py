"""Command line: ``emit`` writes a dataset, ``verify`` checks one. Exit code 2: unknown tier, missing or changed files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .sources import datasets
from .sources.specs import RECIPES


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="regloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    emit = commands.add_parser("emit")
    emit.add_argument("--tier", required=True)
    emit.add_argument("--out", required=True)
    emit.add_argument("--seed", type=int, default=0)
    emit.add_argument("--mode", choices=("exact", "counter"), default="exact")
    emit.add_argument("--single", action="store_true", help="one file for each split, written in order")
    emit.add_argument("--rows", type=int, default=None, help="rows of each split, for trials")
    verify = commands.add_parser("verify")
    verify.add_argument("--dataset", required=True)
    args = parser.parse_args(argv)
    if args.command == "emit" and args.tier not in RECIPES:
        print(f"unknown tier {args.tier!r}; there are {', '.join(RECIPES)}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("regloom").getOrCreate()
    if args.command == "emit":
        recipe = RECIPES[args.tier]
        recipe = recipe.sized(args.rows, args.rows) if args.rows else recipe
        print(datasets.emit(spark, recipe, args.out, args.seed, args.mode, args.single))
        return 0
    try:
        problems = datasets.verify(spark, args.dataset)
    except FileNotFoundError as error:
        print(error, file=sys.stderr)
        return 2
    found = 0
    for r in problems.orderBy("path").toLocalIterator():
        print(f"{r.path}: {r.problem}", file=sys.stderr)
        found += 1
    return 2 if found else 0


if __name__ == "__main__":
    sys.exit(main())
