"""Command line: list the queries, run some of them or a whole stage of the build.

    python -m belated list
    python -m belated run cohort static_features --data DIR --out DIR [--csv] [--fresh]
    python -m belated build --data DIR --out DIR
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from .plans.registry import ORACLE_SQL, QUERIES
from .sources import sinks

#: The feature build in order: each table is written once and kept.
BUILD = ("cohort", "static_features", "annual_counts", "beauty_labels", "beauty_11yr", "citation_features_3_5", "citation_features_7_5", "citation_features_11_5", "maintenance_flags", "shape_features", "citer_quality_7_5", "model_table")


def run(spark: SparkSession, names: list[str], data: str, out: str, csv: bool = False, fresh: bool = False) -> dict[str, float]:
    """Write each query's table under ``out``, unless it is there whole; seconds taken."""
    took = {}
    for name in names:
        began, path = time.perf_counter(), f"{out}/{name}"
        if fresh and sinks.exists(spark, path):
            sinks.write_parquet(QUERIES[name](spark, data), path)
        df = sinks.cached_stage(spark, path, lambda name=name: QUERIES[name](spark, data))
        if csv:
            sinks.write_csv(df, f"{path}.csv")
        took[name] = time.perf_counter() - began
    return took


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="belated", description="Delayed-recognition analytics on Spark")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    for name, help_ in (("run", "write the tables of queries"), ("build", "write the tables of the feature build")):
        c = commands.add_parser(name, help=help_)
        if name == "run":
            c.add_argument("query", nargs="+", choices=sorted(QUERIES), metavar="QUERY")
        c.add_argument("--data", required=True)
        c.add_argument("--out", required=True)
        c.add_argument("--csv", action="store_true", help="a CSV report beside each table")
        c.add_argument("--fresh", action="store_true", help="write tables that are there again")
    a = parser.parse_args(arguments)
    if a.command == "list":
        print("\n".join(f"{n}{' (SQL)' if n in ORACLE_SQL else ''}" for n in sorted(QUERIES)))
        return
    spark = SparkSession.builder.appName("belated").getOrCreate()
    for name, seconds in run(spark, a.query if a.command == "run" else list(BUILD), a.data, a.out, a.csv, a.fresh).items():
        print(f"{name}: {seconds:.1f} s")


if __name__ == "__main__":
    main()
