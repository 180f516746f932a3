"""Command line: query, measure, detect, statistics, store and types over canonical Parquet."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.operators import aggregate, detect, reports, rules, sigma, views
from chronolith.operators.predicates import from_expression, where
from chronolith.schema import canonical, observed
from chronolith.sources.store import Store


def _show(df: DataFrame, limit: int) -> None:
    """At most ``limit`` rows as JSON lines."""
    for (r,) in df.limit(limit).select(F.to_json(F.struct("*"))).collect():
        print(r)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="chronolith", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("query", "measure", "detect", "statistics", "store"):
        sub = commands.add_parser(name)
        sub.add_argument("path")
        sub.add_argument("--where", help="an expression over fields, such as: event_id in (4624, 4625) and User == 'bob'")
        sub.add_argument("--types", nargs="*", help="typed views")
        sub.add_argument("--limit", type=int, default=100)
        if name == "measure":
            sub.add_argument("--by", nargs="*", default=["type"])
            sub.add_argument("--bucket", choices=["Hour", "Day", "Week", "Month"])
            sub.add_argument("--zone", default="UTC")
            sub.add_argument("--top", type=int)
        if name == "detect":
            sub.add_argument("--sigma", help="a YAML file; without it the built-in packs run")
        if name == "store":
            sub.add_argument("target")
    commands.add_parser("types")
    given = parser.parse_args(args)
    if given.command == "types":
        print("\n".join([*views.VIEWS, *views.COMPOSITES]))
        return 0
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    rows = canonical(spark.read.parquet(given.path))
    if given.types:
        rows = views.typed(rows, given.types)
    if given.where:
        rows = where(rows, from_expression(given.where))
    if given.command == "query":
        _show(rows.orderBy(F.col("time_created").desc(), F.col("record_id").desc()), given.limit)
    elif given.command == "measure":
        _show(aggregate.aggregate(rows, aggregate.Definition(tuple(given.by), bucket=given.bucket, zone=given.zone, top=given.top)), given.limit)
    elif given.command == "statistics":
        _show(reports.statistics(rows), given.limit)
    elif given.command == "detect":
        if given.sigma:
            with open(given.sigma, encoding="utf-8") as f:
                made, refused = sigma.compile_documents(sigma.load(f.read()))
            for name, why in refused:
                print(f"refused {name}: {why}")
        else:
            made = [r for pack in rules.BUILT_IN for r in pack.rules]
        _show(detect.evaluate(observed(rows), made), given.limit)
    else:
        Store(spark, given.target).write(rows)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
