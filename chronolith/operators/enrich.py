"""Enrichment from outside and triage of captured text."""

from __future__ import annotations

import socket
from collections.abc import Callable, Iterator, Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith.functions.text import key_value_lines
from chronolith.operators.predicates import Predicate, compile_predicate


def reverse_name(address: str) -> str | None:
    """The host name of an address; None if it has none."""
    try:
        return socket.gethostbyaddr(address)[0]
    except OSError:
        return None


def resolve_names(rows: DataFrame, column: str, into: str = "host_name", lookup: Callable[[str], str | None] = reverse_name) -> DataFrame:
    """``rows`` with the host names of a column of addresses.

    Each distinct address is looked up once, in tasks that hold only addresses; the answers
    come back by a join that is broadcast when they are few.
    """

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"_address": pdf["_address"], "_name": [lookup(a) for a in pdf["_address"]]})

    distinct = rows.select(F.col(column).alias("_address")).where(F.col("_address").isNotNull()).distinct()
    names = distinct.mapInPandas(asked, T.StructType([T.StructField("_address", T.StringType()), T.StructField("_name", T.StringType())]))
    return rows.join(names, rows[column] == names["_address"], "left").drop("_address").withColumnRenamed("_name", into)


def triage(rows: DataFrame, column: str, checks: Mapping[str, Predicate]) -> DataFrame:
    """``rows`` with fields (the ``key : value`` lines of a capture) and the names of the checks that hold for them."""
    parsed = rows.withColumn("values", key_value_lines(F.col(column), " :"))
    hits = F.array_compact(F.array(*[F.when(compile_predicate(p, parsed), F.lit(n)) for n, p in checks.items()]))
    return parsed.withColumn("failed_checks", hits).withColumnRenamed("values", "fields")


def keep(rows: DataFrame, *conditions) -> DataFrame:
    """Rows that every condition takes: columns, or functions of a pandas frame that give a boolean series."""
    plain = [c for c in conditions if not callable(c)]
    out = rows.where(reduce(lambda a, b: a & b, plain)) if plain else rows
    for test in (c for c in conditions if callable(c)):
        out = out.mapInPandas(lambda it, test=test: (pdf[test(pdf).astype(bool)] for pdf in it), rows.schema)
    return out
