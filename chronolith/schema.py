"""The canonical event row, its aliases, and adapters into it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = T.StringType()
_TYPES = {
    "time_created": T.TimestampType(), "type": _TEXT, "event_id": T.IntegerType(), "record_id": T.LongType(), "provider": _TEXT, "source_log": _TEXT, "container_log": _TEXT, "source_kind": _TEXT,
    "source_computer": _TEXT, "collector_computer": _TEXT, "level": _TEXT, "level_value": T.ShortType(), "activity_id": _TEXT, "related_activity_id": _TEXT, "process_id": T.IntegerType(), "thread_id": T.IntegerType(),
    "message": _TEXT, "observation_identity": _TEXT, "received_time": T.TimestampType(), "processed_time": T.TimestampType(), "stored_time": T.TimestampType(), "values": T.MapType(_TEXT, _TEXT),
}
CANONICAL = T.StructType([T.StructField(n, t) for n, t in _TYPES.items()])
COMMON = [f.name for f in CANONICAL.fields if f.name != "values"]

#: Other names of the common columns, lower-cased.
ALIASES = {
    "id": "event_id",
    "eventid": "event_id",
    "when": "time_created",
    "timecreated": "time_created",
    "computer": "source_computer",
    "machinename": "source_computer",
    "sourcecomputer": "source_computer",
    "collectorcomputer": "collector_computer",
    "gatheredfrom": "collector_computer",
    "logname": "source_log",
    "channel": "source_log",
    "sourcelog": "source_log",
    "containerlog": "container_log",
    "providername": "provider",
    "recordid": "record_id",
    "typename": "type",
    "activityid": "activity_id",
    "relatedactivityid": "related_activity_id",
    "leveldisplayname": "level",
}


def canonical(df: DataFrame, *payload_columns: str) -> DataFrame:
    """``df`` cast to the canonical row; columns that it lacks are null. ``payload_columns`` stay behind it."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[f.name]}`").cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in CANONICAL.fields], *payload_columns)


#: Event codes of the application event types.
APP_CODES = (("click", 1001), ("error", 1002), ("purchase", 1003), ("signup", 1004), ("view", 1005))


def from_app_events(events: DataFrame) -> DataFrame:
    """Canonical rows of an application event table (event_id, ts, user_id, event_type, value, props).

    The payload also stays in columns of its own, value and k: ``resolve`` prefers them to
    the map, so filters on them reach the scan and nobody reads what they do not name.
    """
    code = F.coalesce(*[F.when(F.col("event_type") == name, number) for name, number in APP_CODES])
    bad = F.col("event_type") == "error"
    made = events.select(
        F.col("ts").alias("time_created"), F.col("event_type").alias("type"), code.alias("event_id"), F.col("event_id").alias("record_id"), F.lit("app").alias("provider"),
        F.lit("Application").alias("source_log"), F.lit("Application").alias("container_log"), F.col("user_id").cast("string").alias("source_computer"), F.lit("collector").alias("collector_computer"),
        F.when(bad, "Error").otherwise("Information").alias("level"), F.when(bad, 2).otherwise(4).cast("smallint").alias("level_value"),
        F.map_from_arrays(F.array(F.lit("value"), F.lit("k")), F.array(F.col("value").cast("string"), F.get_json_object("props", "$.k"))).alias("values"),
        F.col("value"), F.get_json_object("props", "$.k").alias("k"),
    )
    return canonical(made, "value", "k")


def payload(key: str, column: str = "values") -> Column:
    """The payload value under ``key``, whatever its case; null where there is none."""
    return F.get(F.map_values(F.map_filter(F.col(column), lambda k, _: F.lower(k) == key.lower())), F.lit(0))


def resolve(df: DataFrame, field: str) -> Column:
    """A field of ``df`` by column name, alias or payload key, in this order, ignoring case."""
    have = {c.lower(): c for c in df.columns}
    name = field.lower()
    if name in have:
        return F.col(f"`{have[name]}`")
    if ALIASES.get(name) in df.columns:
        return F.col(ALIASES[name])
    if "values" in df.columns:
        return payload(field)
    raise ValueError(f"no field {field!r}")


#: What identifies an observation, in order.
_IDENTITY = ("source_kind", "source_computer", "collector_computer", "source_log", "container_log", "provider", "event_id", "record_id", "time_created", "level_value", "activity_id", "related_activity_id", "process_id", "thread_id", "type", "message")


def observed(rows: DataFrame) -> DataFrame:
    """``rows`` with observation_identity (upper-case SHA-256 of what identifies them) and fields: payload and common columns in one map, the common ones winning."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _IDENTITY]
    identity = F.upper(F.sha2(F.to_json(F.array(*parts, F.coalesce(F.to_json(F.array_sort(F.map_entries("values"))), F.lit("")))), 256))
    shown = {"SourceComputer": "source_computer", "CollectorComputer": "collector_computer", "ActivityId": "activity_id", "RelatedActivityId": "related_activity_id", "ProcessId": "process_id"}
    common = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value")) for k, c in shown.items()]), lambda e: e["value"].isNotNull()))
    own = F.map_filter(F.coalesce("values", F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(common, k))
    return rows.withColumn("observation_identity", identity).withColumn("fields", F.map_concat(own, common))
