"""Scans: sources put together in one order, flat filters, limits, resumption, inventories."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions.text import wildcard_regex
from chronolith.operators.predicates import Predicate, compile_predicate, folded_in
from chronolith.schema import COMMON, payload

#: What each read mode takes of a row.
READ_MODES = {
    "Metadata": [c for c in COMMON if c != "message"],
    "Message": COMMON,
    "StructuredData": [c for c in COMMON if c != "message"] + ["values"],
    "StructuredDataAndMessage": [*COMMON, "values"],
    "Full": [*COMMON, "values"],
}


def merged(sources: Sequence[DataFrame], newest_first: bool = True, limit: int | None = None) -> DataFrame:
    """All sources in one total order: time, computer, log, record, event, source; a limit is pushed to each source."""
    order = ["time_created", "source_computer", "source_log", "record_id", "event_id", "source_index"]
    rows = reduce(DataFrame.unionByName, [s.withColumn("source_index", F.lit(i)) for i, s in enumerate(sources)])
    rows = rows.orderBy(*[F.col(c).desc_nulls_last() if newest_first else F.col(c).asc_nulls_first() for c in order])
    return rows.limit(limit) if limit is not None else rows


def raw_order(rows: DataFrame) -> DataFrame:
    """Rows in the order of raw events: time, record id (null first), provider, log, computer, id."""
    return rows.orderBy("time_created", F.col("record_id").asc_nulls_first(), "provider", "source_log", "source_computer", "event_id")


def forwarded(rows: DataFrame, sources: dict[str, tuple[set[int], set[str]]], computers: Sequence[str] = ()) -> DataFrame:
    """Rows that a collector holds for other logs: kept in ForwardedEvents, and from a log, id and provider that ``sources`` asks for.

    ``computers`` limits the computers that they come from; texts compare without case.
    """
    kept = folded_in(F.col("container_log"), ["ForwardedEvents"])
    if computers:
        kept = kept & folded_in(F.col("source_computer"), computers)
    parts = []
    for log, (ids, providers) in sources.items():
        part = folded_in(F.col("source_log"), [log])
        if ids:
            part = part & F.col("event_id").isin(sorted(ids))
        if providers:
            part = part & folded_in(F.col("provider"), sorted(providers))
        parts.append(part)
    return rows.where(kept & reduce(lambda a, b: a | b, parts, F.lit(False)))


def limited(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(at most ``limit`` rows, one row that tells whether there were more)."""
    probe = rows.limit(limit + 1).agg((F.count(F.lit(1)) > limit).alias("limit_reached"))
    return rows.limit(limit), probe


def read(rows: DataFrame, mode: str = "Full") -> DataFrame:
    """The columns of a read mode, so that the scan reads no others."""
    return rows.select(*READ_MODES[mode])


def after(rows: DataFrame, record_id: int | None = None, cursor: tuple[datetime, int] | None = None) -> DataFrame:
    """Rows behind a checkpoint: a record id, or a (time, record id) cursor for keyset paging."""
    if record_id is not None:
        rows = rows.where(F.col("record_id") > record_id)
    if cursor is not None:
        time, number = F.lit(cursor[0]), F.lit(cursor[1])
        rows = rows.where((F.col("time_created") > time) | (F.col("time_created") == time) & (F.col("record_id") > number))
    return rows


def page(rows: DataFrame, size: int, cursor: tuple[datetime, int] | None = None) -> DataFrame:
    """The next page by (time_created, record_id)."""
    return after(rows, cursor=cursor).orderBy("time_created", "record_id").limit(size)


@dataclass(frozen=True)
class Filter:
    """A flat filter; every part that is given must hold. Payload texts compare with case, payload keys without."""

    event_ids: tuple[int, ...] = ()
    record_ids: tuple[int, ...] = ()
    record_between: tuple[int | None, int | None] = (None, None)  # both exclusive
    providers: tuple[str, ...] = ()
    levels: tuple[int, ...] = ()
    start: datetime | None = None
    end: datetime | None = None
    data: tuple[str, ...] = ()
    named_data: tuple[tuple[str, tuple[str, ...]], ...] = ()
    excluded_data: tuple[str, ...] = ()
    excluded_ids: tuple[int, ...] = ()
    excluded_named_data: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def column(self) -> Column:
        """The conjunction, for a filter (null is false); id, level and time parts reach the scan."""
        parts = []
        for names, column in ((self.event_ids, "event_id"), (self.record_ids, "record_id"), (self.levels, "level_value")):
            if names:
                parts.append(F.col(column).isin(list(names)))
        low, high = self.record_between
        if low is not None:
            parts.append(F.col("record_id") > low)
        if high is not None:
            parts.append(F.col("record_id") < high)
        if self.providers:
            parts.append(F.upper("provider").isin([p.upper() for p in self.providers]))
        if self.start is not None:
            parts.append(F.col("time_created") >= F.lit(self.start))
        if self.end is not None:
            parts.append(F.col("time_created") <= F.lit(self.end))
        holds = lambda texts: F.exists(F.map_values("values"), lambda v: v.isin(list(texts)))
        if self.data:
            parts.append(holds(self.data))
        for key, texts in self.named_data:
            parts.append(payload(key).isin(list(texts)))
        if self.excluded_ids:
            parts.append(~F.coalesce(F.col("event_id").isin(list(self.excluded_ids)), F.lit(False)))
        if self.excluded_data:
            parts.append(~F.coalesce(holds(self.excluded_data), F.lit(False)))
        if self.excluded_named_data:  # a row goes only if it has all keys and all match
            every = reduce(lambda a, b: a & b, [F.coalesce(payload(k).isin(list(t)), F.lit(False)) for k, t in self.excluded_named_data])
            parts.append(~every)
        return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def intersect(a: Filter, b: Filter) -> Filter | None:
    """Both filters in one; None if they contradict each other."""
    made = {}
    for name in ("event_ids", "record_ids", "providers", "levels"):
        x, y = getattr(a, name), getattr(b, name)
        if x and y:
            fold = str.upper if name == "providers" else lambda v: v
            common = tuple(v for v in x if fold(v) in {fold(w) for w in y})
            if not common:
                return None
            made[name] = common
        else:
            made[name] = x or y
    made["start"], made["end"] = max(filter(None, (a.start, b.start)), default=None), min(filter(None, (a.end, b.end)), default=None)
    low = max((v for v in (a.record_between[0], b.record_between[0]) if v is not None), default=None)
    high = min((v for v in (a.record_between[1], b.record_between[1]) if v is not None), default=None)
    if made["start"] and made["end"] and made["start"] > made["end"] or low is not None and high is not None and high - low < 2:
        return None
    for name in ("named_data", "excluded_data", "excluded_ids"):
        made[name] = tuple(dict.fromkeys((*getattr(a, name), *getattr(b, name))))
    if a.data and b.data or a.excluded_named_data and b.excluded_named_data:
        raise ValueError("two filters on any payload text, or on excluded named data, do not fold into one; apply both")
    return Filter(record_between=(low, high), data=a.data or b.data, excluded_named_data=a.excluded_named_data or b.excluded_named_data, **made)


def structured(rows: DataFrame, select: Sequence[Predicate], suppress: Sequence[Predicate] = ()) -> DataFrame:
    """Rows that any select takes and no suppress does."""
    take = reduce(lambda a, b: a | b, [compile_predicate(p, rows) for p in select])
    drop = reduce(lambda a, b: a | b, [compile_predicate(p, rows) for p in suppress], F.lit(False))
    return rows.where(take & ~drop)


def inventory(rows: DataFrame, column: str, pattern: str = "*") -> DataFrame:
    """The distinct channels, providers or the like whose name matches a wildcard."""
    return rows.select(F.col(column).alias("name")).where(F.col("name").rlike("(?i)" + wildcard_regex(pattern))).distinct()


def latest(rows: DataFrame) -> DataFrame:
    """For each log its newest event and how many there are."""
    return rows.groupBy("source_log").agg(F.max("time_created").alias("latest"), F.count(F.lit(1)).alias("events"))


def probe(rows: DataFrame, logs: DataFrame, asked: Predicate | None = None) -> DataFrame:
    """(source_log, status, latest, events, all_events) for each name in ``logs`` (source_log), ignoring case.

    ``events`` counts the rows that ``asked`` takes, ``all_events`` every row of the log.
    Status: Ok; NoUsableTimestamp where no such row has a time; NoEvent where the log has
    rows but none that is asked for; LogNotFound where it has none. One aggregation; a name
    that comes twice is answered twice.
    """
    take = F.lit(True) if asked is None else F.coalesce(compile_predicate(asked, rows), F.lit(False))
    name = F.upper("source_log")
    held = rows.groupBy(name.alias("_log")).agg(F.count(F.lit(1)).alias("all_events"), F.count_if(take).alias("events"), F.max(F.when(take, F.col("time_created"))).alias("latest"))
    status = F.when(F.col("all_events").isNull(), "LogNotFound").when(F.col("events") == 0, "NoEvent").when(F.col("latest").isNull(), "NoUsableTimestamp").otherwise("Ok")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return logs.join(held, name == F.col("_log"), "left").select("source_log", status.alias("status"), "latest", count("events"), count("all_events"))


def generic_columns(rows: DataFrame, most: int = 12) -> DataFrame:
    """``rows`` with a column for each payload key, or one Details column if there are more than ``most`` keys.

    At most ``most`` + 1 key names come to the driver.
    """
    keys = [r[0] for r in rows.select(F.explode(F.map_keys("values")).alias("k")).distinct().orderBy("k").limit(most + 1).collect()]
    if len(keys) > most:
        shown = F.concat_ws("; ", F.transform(F.array_sort(F.map_entries("values")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))))
        return rows.withColumn("Details", shown).drop("values")
    return rows.select(*[c for c in rows.columns if c != "values"], *[F.element_at("values", k).alias(f"values.{k}") for k in keys])


def sections(rows: DataFrame, types: Sequence[str]) -> dict[str, DataFrame]:
    """One homogeneous section a type."""
    return {t: rows.where(F.col("type") == t) for t in types}


def missing(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is expected and was not observed, ignoring the case of texts."""
    fold = lambda df, c: F.upper(df[c]) if dict(df.dtypes)[c] == "string" else df[c]
    return expected.join(observed, reduce(lambda a, b: a & b, [fold(expected, k).eqNullSafe(fold(observed, k)) for k in keys]), "left_anti")
