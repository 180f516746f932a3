"""Bounded aggregation: groups, calendar buckets, measures and top-N.

Groups and distinct values ignore case and how a Latin letter's marks are written (``text.composed``; ``text.nfc``
does so for every script and goes through Python); a group shows the least of its variants. Ties and output order follow
the group's identity, a text that gives each key's type and length before its value.
Sets and counts are exact. Bounds never truncate: ``complete`` tells whether the groups
and distinct values stayed within them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from chronolith.functions.text import composed
from chronolith.functions.times import calendar_end, calendar_start
from chronolith.schema import resolve

MAX_GROUPS, MAX_DISTINCT = 25_000, 100_000


@dataclass(frozen=True)
class Measure:
    """kind: Count, DistinctCount, FirstSeen, LastSeen or Rate (per ``unit_seconds``)."""

    kind: str
    name: str
    field: str = ""
    include_nulls: bool = False
    unit_seconds: float = 3600.0


@dataclass(frozen=True)
class Definition:
    group_by: tuple[str, ...] = ()
    measures: tuple[Measure, ...] = (Measure("Count", "count"),)
    bucket: str | None = None
    zone: str = "UTC"
    include_null_groups: bool = True
    window: tuple[datetime, datetime] | None = None
    top: int | None = None
    rank_by: str = "count"
    scope: str = "rows"  # rows, global (over all buckets) or bucket


def _typed(df: DataFrame, field: str) -> tuple[Column, str]:
    column = resolve(df, field)
    kind = df.select(column.alias("x")).schema["x"].dataType
    name = "Number" if isinstance(kind, T.NumericType) else "DateTime" if isinstance(kind, T.TimestampType) else "Boolean" if isinstance(kind, T.BooleanType) else "Text"
    return column, name


def identity(pairs: Sequence[tuple[Column, str]]) -> Column:
    """The identity of a group from (value, type name) pairs."""
    parts = []
    for value, name in pairs:
        text = F.upper(composed(value.cast("string"))) if name == "Text" else F.upper(value.cast("string"))
        shown = F.concat(F.lit(f"{len(name)}:{name}"), F.length(text).cast("string"), F.lit(":"), text, F.lit("|"))
        parts.append(F.when(value.isNull(), "4:Null0:|").otherwise(shown))
    return F.concat(*parts) if parts else F.lit("")


def _time(df: DataFrame, field: str) -> Column:
    column, name = _typed(df, field)
    return column if name == "DateTime" else F.to_timestamp(column)  # text that is no time raises


def _measures(df: DataFrame, d: Definition) -> list[Column]:
    out = []
    for m in d.measures:
        if m.kind in ("Count", "Rate"):
            made = F.count(F.lit(1))
        elif m.kind == "DistinctCount":
            value, name = _typed(df, m.field)
            value = F.upper(composed(value.cast("string"))) if name == "Text" else F.upper(value.cast("string"))
            made = F.countDistinct(value) + (F.max(value.isNull().cast("long")) if m.include_nulls else F.lit(0))
        elif m.kind in ("FirstSeen", "LastSeen"):
            made = (F.min if m.kind == "FirstSeen" else F.max)(_time(df, m.field))
        else:
            raise ValueError(f"no measure {m.kind!r}")
        out.append(made.alias(m.name))
    return out


def aggregate(df: DataFrame, d: Definition) -> DataFrame:
    """Columns: bucket_start and bucket_end if bucketed, the group fields, the measures; ordered by bucket and identity."""
    names = [f.lower() for f in d.group_by]
    if len(set(names)) != len(names) or any(m.kind == "Rate" for m in d.measures) and not (d.bucket or d.window):
        raise ValueError("group fields must differ, and a rate needs a bucket or a window")
    pairs = [_typed(df, f) for f in d.group_by]
    keyed = df.withColumn("_identity", identity(pairs))
    if not d.include_null_groups:
        for value, _ in pairs:
            keyed = keyed.where(value.isNotNull())
    keys = ["_identity"]
    if d.bucket:
        keyed = keyed.withColumn("bucket_start", calendar_start(F.col("time_created"), d.bucket, d.zone))
        keys = ["bucket_start", *keys]
    shown = [F.min(value).alias(f) for (value, _), f in zip(pairs, d.group_by)]
    out = keyed.groupBy(*keys).agg(*shown, *_measures(df, d))
    if d.bucket:
        out = out.withColumn("bucket_end", calendar_end(F.col("bucket_start"), d.bucket, d.zone))
    for m in d.measures:
        if m.kind == "Rate":
            seconds = (F.unix_micros("bucket_end") - F.unix_micros("bucket_start")) / 1e6 if d.bucket else F.lit((d.window[1] - d.window[0]).total_seconds())
            out = out.withColumn(m.name, F.col(m.name) / (seconds / F.lit(float(m.unit_seconds))))
    if d.top is not None:
        out = _top(keyed, out, df, d)
    order = [c for c in ("bucket_start", "_identity") if c in out.columns]
    return out.orderBy(*order).select(*[c for c in ("bucket_start", "bucket_end") if d.bucket], *d.group_by, *[m.name for m in d.measures])


def _top(keyed: DataFrame, out: DataFrame, df: DataFrame, d: Definition) -> DataFrame:
    best = [F.col(d.rank_by).desc_nulls_last(), F.col("_identity")]
    if d.scope == "bucket":
        return out.withColumn("_n", F.row_number().over(Window.partitionBy("bucket_start").orderBy(*best))).where(F.col("_n") <= d.top)
    if d.scope == "global":
        totals = keyed.groupBy("_identity").agg(*_measures(df, d)).orderBy(*best).limit(d.top).select("_identity")
        return out.join(totals, "_identity", "left_semi")
    return out.orderBy(*best).limit(d.top)


def complete(df: DataFrame, d: Definition, max_groups: int = MAX_GROUPS, max_distinct: int = MAX_DISTINCT) -> DataFrame:
    """One row: the number of groups (counted no further than the bound and one) and whether all bounds hold."""
    pairs = [_typed(df, f) for f in d.group_by]
    keys = [identity(pairs).alias("_identity"), *([calendar_start(F.col("time_created"), d.bucket, d.zone).alias("_bucket")] if d.bucket else [])]
    groups = df.select(*keys).distinct().limit(max_groups + 1).agg(F.count(F.lit(1)).alias("groups"))
    counted = [_typed(df, m.field)[0] for m in d.measures if m.kind == "DistinctCount"]
    if counted:
        values = df.select(F.explode(F.array_distinct(F.array(*[F.upper(c.cast("string")) for c in counted])))).distinct().limit(max_distinct + 1).agg(F.count(F.lit(1)).alias("distinct_values"))
        groups = groups.crossJoin(values)  # one row by one row
    else:
        groups = groups.withColumn("distinct_values", F.lit(0).cast("long"))
    return groups.withColumn("complete", (F.col("groups") <= max_groups) & (F.col("distinct_values") <= max_distinct))


def store_summary(rows: DataFrame, unit: str = "Day") -> DataFrame:
    """(period, type): count, first and last."""
    return rows.groupBy(calendar_start(F.col("time_created"), unit).alias("period"), "type").agg(F.count(F.lit(1)).alias("count"), F.min("time_created").alias("first_seen"), F.max("time_created").alias("last_seen"))


def by_dimensions(rows: DataFrame, dimensions: dict[str, Column], top: int | None = None) -> DataFrame:
    """(dimension, value, count) for several dimensions in one pass: one exploded array, one aggregation; blank values are left out."""
    pairs = F.array(*[F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("value")) for n, c in dimensions.items()])
    counted = rows.select(F.explode(pairs).alias("p")).where(F.trim("p.value") != "").groupBy(F.col("p.dimension").alias("dimension"), F.col("p.value").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    if top is None:
        return counted
    rank = F.row_number().over(Window.partitionBy("dimension").orderBy(F.col("count").desc(), F.upper("value"), "value"))
    return counted.withColumn("_n", rank).where(F.col("_n") <= top).drop("_n")


def chart_series(aggregated: DataFrame, bucket: str, series: str, value: str, names: Sequence[str]) -> DataFrame:
    """A bucketed aggregation with a column a series."""
    return aggregated.groupBy(bucket).pivot(series, list(names)).agg(F.sum(value))
