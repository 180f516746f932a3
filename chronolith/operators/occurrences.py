"""Occurrences: which rows tell of the same event.

``none`` keeps every row apart, ``transport`` puts together copies of one record that came
by several ways, ``semantic`` also joins transport groups of one producer and computer
that share a causal identifier, as long as the joined span stays within a window.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronolith.functions.text import indented
from chronolith.schema import payload

#: Payload fields that name a cause, in order; the spellings of the activity id count as one.
CAUSAL_FIELDS = ("OperationCorrelationId", "ApplicationCorrelationId", "CorrelationId", "RelatedActivityId", "ActivityId", "ActivityID", "TransactionId", "BatchId")
_EMPTY_GUID = "00000000-0000-0000-0000-000000000000"
_TRANSPORT = ["source_computer", "source_log", "record_id", "provider", "event_id", "time_created"]


def fingerprint(*columns: str) -> Column:
    """A hash of columns that knows null from empty."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.concat(F.lit("="), F.upper(F.col(c).cast("string"))), F.lit("")) for c in columns])), 256)


def none(rows: DataFrame) -> DataFrame:
    """Every row its own occurrence, named by its fingerprint and its number among equal rows."""
    made = rows.withColumn("_f", fingerprint(*_TRANSPORT, "type", "message"))
    number = F.row_number().over(Window.partitionBy("_f").orderBy("observation_identity", "collector_computer"))
    return made.withColumn("occurrence", F.concat_ws("-", "_f", number)).drop("_f")


def transport(rows: DataFrame) -> DataFrame:
    """Copies of one record share an occurrence: equal computer, log, record, provider (trimmed, without case), id and time.

    A row without record id, or with a blank computer or log, stays single.
    """
    known = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    single = F.concat(F.lit("row-"), fingerprint(*_TRANSPORT, "type", "message", "observation_identity", "collector_computer", "container_log"))
    parts = [F.upper(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in _TRANSPORT]
    whole = F.sha2(F.to_json(F.array(*parts)), 256)
    return rows.withColumn("occurrence", F.when(F.col("record_id").isNotNull() & known("source_computer") & known("source_log"), whole).otherwise(single))


def evidence_count() -> Column:
    """Payload values that say something: not null and not empty once normalized."""
    return F.size(F.filter(F.map_values(F.coalesce("values", F.create_map().cast("map<string,string>"))), lambda v: F.trim(v) != ""))


def representative(rows: DataFrame) -> DataFrame:
    """One row an occurrence, with the number of its copies.

    The one with most evidence comes first, then a direct one (kept in its own log, collected
    by its own computer), the earliest, then by computer, record id (null first) and fingerprint.
    """
    by = Window.partitionBy("occurrence")
    same = lambda a, b: F.coalesce(F.upper(a) == F.upper(b), F.lit(False))
    direct = same("source_log", "container_log") & same("source_computer", "collector_computer")
    first = F.row_number().over(by.orderBy(evidence_count().desc(), direct.desc(), "time_created", F.upper("source_computer"), F.col("record_id").asc_nulls_first(), fingerprint(*_TRANSPORT, "type", "message", "container_log", "collector_computer")))
    return rows.withColumn("copies", F.count(F.lit(1)).over(by)).withColumn("_n", first).where("_n = 1").drop("_n")


def bounds(rows: DataFrame, grouped: DataFrame, max_observations: int = 100_000, max_groups: int = 25_000) -> DataFrame:
    """(bound, value, allowed) that a grouping passes, counted no further than the bound and one; empty if it keeps both. Nothing is cut."""
    seen = rows.limit(max_observations + 1).agg(F.lit("observations").alias("bound"), F.count(F.lit(1)).alias("value"), F.lit(max_observations).cast("long").alias("allowed"))
    found = grouped.select("occurrence").distinct().limit(max_groups + 1).agg(F.lit("groups").alias("bound"), F.count(F.lit(1)).alias("value"), F.lit(max_groups).cast("long").alias("allowed"))
    return seen.unionByName(found).where("value > allowed")


def bounded(rows: DataFrame, group: Callable[[DataFrame], DataFrame], **limits: int) -> tuple[DataFrame, list[str]]:
    """(grouped rows, no bounds), or (no rows, the bounds that were passed): a result is whole or empty."""
    grouped = group(rows)
    passed = sorted(r["bound"] for r in bounds(rows, grouped, **limits).collect())  # two rows at most
    return (grouped.where(F.lit(False)), passed) if passed else (grouped, [])


def causes() -> Column:
    """The causal identifiers of a row: distinct ``field=value`` texts."""
    own = [F.when(F.lower(F.col(c)) != _EMPTY_GUID, F.concat(F.lit("ACTIVITYID="), F.upper(F.col(c)))) for c in ("related_activity_id", "activity_id")]
    for field in CAUSAL_FIELDS:
        name = "ACTIVITYID" if field.upper() in ("RELATEDACTIVITYID", "ACTIVITYID") else field.upper()
        value = F.trim(payload(field))
        own.append(F.when((value != "") & (value != "-"), F.concat(F.lit(f"{name}="), F.upper(value))))
    return F.array_distinct(F.array_compact(F.array(*own)))


def _joined(window_us: int):
    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["first_us", "occurrence"], kind="stable").reset_index(drop=True)
        root, low, high = list(range(len(pdf))), pdf["first_us"].tolist(), pdf["last_us"].tolist()

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        held: dict[str, list[int]] = {}
        for i, own in enumerate(pdf["causes"]):
            for c in own:
                held.setdefault(c, []).append(i)
        for c in sorted(held):
            at = held[c][0]
            for nxt in held[c][1:]:
                a, b = find(at), find(nxt)
                if a != b:
                    if max(high[a], high[b]) - min(low[a], low[b]) > window_us:
                        at = nxt
                        continue
                    a, b = min(a, b), max(a, b)
                    root[b], low[a], high[a] = a, min(low[a], low[b]), max(high[a], high[b])
                at = find(nxt)
        names = pdf["occurrence"].tolist()
        return pd.DataFrame({"occurrence": names, "semantic": [names[find(i)] for i in range(len(pdf))]})

    return group


def semantic(rows: DataFrame, window_seconds: float = 10.0) -> DataFrame:
    """Transport groups joined by shared causes within the window.

    Causes never reach over (producer, computer), and a gap longer than the window between
    consecutive groups of such a key cannot be bridged by it, so each run between gaps is
    joined alone: a hot producer is many small groups.
    """
    us = int(window_seconds * 1_000_000)
    moved = transport(rows).withColumn("_producer", F.upper(F.coalesce("provider", "type"))).withColumn("_computer", F.upper(F.coalesce("source_computer", F.lit(""))))
    groups = moved.groupBy("occurrence", "_producer", "_computer").agg(F.min(F.unix_micros("time_created")).alias("first_us"), F.max(F.unix_micros("time_created")).alias("last_us"), F.array_distinct(F.flatten(F.collect_set(causes()))).alias("causes")).where(F.size("causes") > 0)
    shares = groups.select("occurrence", "_producer", "_computer", "first_us", F.explode("causes").alias("cause"))
    by_cause = Window.partitionBy("_producer", "_computer", "cause").orderBy("first_us", "occurrence")
    near = shares.withColumn("_before", F.lag("first_us").over(by_cause)).withColumn("_after", F.lead("first_us").over(by_cause))
    linked = near.where((F.col("first_us") - F.col("_before") <= us) | (F.col("_after") - F.col("first_us") <= us)).select("occurrence").distinct()
    linked = groups.join(linked, "occurrence", "left_semi")  # the others stay alone, whatever their number
    in_order = Window.partitionBy("_producer", "_computer").orderBy("first_us", "occurrence")
    breaks = F.when(F.col("first_us") - F.lag("first_us").over(in_order) > us, 1).otherwise(0)
    runs = linked.withColumn("_break", breaks).withColumn("_run", F.sum("_break").over(in_order)).drop("_break")
    named = runs.groupBy("_producer", "_computer", "_run").applyInPandas(_joined(us), "occurrence string, semantic string")
    return moved.join(named, "occurrence", "left").withColumn("occurrence", F.coalesce("semantic", "occurrence")).drop("semantic", "_producer", "_computer")


def reassemble(fragments: DataFrame, indent: bool = False) -> DataFrame:
    """Scripts from their parts (script_block_id, message_number, message_total, script_block_text, time_created).

    A part that comes twice counts once, the earliest; number 0 is metadata. A script is
    complete when it has each part from 1 to its total. ``indent`` lays it out by its braces.
    """
    parts = fragments.where("message_number > 0").groupBy("script_block_id", "message_number").agg(F.min_by("script_block_text", "time_created").alias("text"), F.max("message_total").alias("total"), F.min("time_created").alias("time"))
    ordered = F.array_sort(F.collect_list(F.struct("message_number", "text")))
    whole = parts.groupBy("script_block_id").agg(ordered.alias("p"), F.max("total").alias("message_total"), F.count(F.lit(1)).alias("parts"), F.max("message_number").alias("_last"), F.min("time").alias("first_time"))
    done = (F.col("parts") == F.col("message_total")) & (F.col("_last") == F.col("message_total"))
    script = F.array_join(F.transform("p", lambda x: x["text"]), "")
    return whole.select("script_block_id", (indented(script) if indent else script).alias("script"), "parts", "message_total", done.alias("complete"), "first_time")


def incomplete(fragments: DataFrame) -> DataFrame:
    """(script_block_id, parts, message_total, missing, first_missing) of scripts that lack parts.

    A part beyond the total is not counted as one of it; a script without a total lacks what
    is not known: missing and first_missing are null.
    """
    parts = fragments.where("message_number > 0").groupBy("script_block_id", "message_number").agg(F.max("message_total").alias("total"))
    held = parts.groupBy("script_block_id").agg(F.array_sort(F.collect_list("message_number")).alias("p"), F.max("total").alias("message_total"))
    inside = held.withColumn("parts", F.size("p").cast("long")).withColumn("p", F.filter("p", lambda n: n <= F.col("message_total")))
    gaps = F.filter(F.transform("p", lambda n, i: F.when(n != i + 1, i + 1)), lambda x: x.isNotNull())
    first = F.coalesce(F.get(gaps, F.lit(0)), F.size("p") + 1)
    shown = inside.withColumn("missing", F.col("message_total").cast("long") - F.size("p")).withColumn("first_missing", F.when(F.col("message_total").isNotNull(), first).cast("long"))
    return shown.where("missing IS NULL OR missing > 0").select("script_block_id", "parts", "message_total", "missing", "first_missing")


def script_bounds(fragments: DataFrame, max_scripts: int = 100_000, max_pending: int = 10_000, max_parts: int = 10_000) -> DataFrame:
    """(bound, value, allowed): scripts, scripts that lack parts, and the most parts of one, where they pass a stated bound; nothing is cut."""
    sizes = fragments.where("message_number > 0").groupBy("script_block_id").agg(F.countDistinct("message_number").alias("n"))
    seen = sizes.agg(F.count(F.lit(1)).alias("scripts"), F.coalesce(F.max("n"), F.lit(0)).alias("parts"))
    waiting = incomplete(fragments).agg(F.count(F.lit(1)).alias("pending"))
    row = lambda name, value, allowed: F.struct(F.lit(name).alias("bound"), F.col(value).alias("value"), F.lit(allowed).cast("long").alias("allowed"))
    counted = seen.select(F.explode(F.array(row("scripts", "scripts", max_scripts), row("parts", "parts", max_parts))).alias("b"))
    return counted.unionByName(waiting.select(row("pending", "pending", max_pending).alias("b"))).select("b.*").where("value > allowed")
