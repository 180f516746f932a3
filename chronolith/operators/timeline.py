"""Correlation timelines, pivots, interval look-ups and attempt segmentation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronolith.functions.text import correlation_id
from chronolith.functions.times import minute_bucket
from chronolith.schema import resolve

#: The dimensions that may correlate, and the named choices of them.
CORRELATION_KEYS = ("who", "object_affected", "computer", "action", "named_event", "event_id", "gathered_from", "gathered_log_name")
PROFILES = {
    "identity": ("who", "object_affected", "computer"),
    "actor_activity": ("who", "action", "computer"),
    "object_activity": ("object_affected", "action", "who"),
    "host_activity": ("computer", "action", "who"),
    "rule_activity": ("named_event", "who", "object_affected"),
}
#: The payload fields of each kind of pivot.
PIVOT_FIELDS = {
    "Actor": ("Who", "SubjectUserName", "SubjectAccountName"),
    "Target": ("ObjectAffected", "TargetUserName", "MemberName", "ObjectName"),
    "Host": ("SourceComputer", "Computer", "CollectorComputer", "WorkstationName"),
    "Account": ("Who", "ObjectAffected", "SubjectUserName", "TargetUserName", "MemberName"),
    "Sid": ("SubjectUserSid", "TargetUserSid", "MemberSid", "ObjectSid"),
    "IpAddress": ("IpAddress", "SourceNetworkAddress", "SourceIp", "DestinationIp"),
    "Process": ("ProcessName", "NewProcessName", "ProcessId", "NewProcessId"),
    "Activity": ("ActivityId", "RelatedActivityId"),
    "Logon": ("LogonId", "TargetLogonId", "SubjectLogonId"),
    "Transaction": ("TransactionId", "CorrelationId", "OperationId"),
}
_COLUMN_OF = {"computer": "source_computer", "named_event": "type", "event_id": "event_id", "gathered_from": "collector_computer", "gathered_log_name": "container_log", "who": "Who", "object_affected": "ObjectAffected", "action": "Action"}


def correlate(rows: DataFrame, keys: Sequence[str] = PROFILES["identity"], keep_uncorrelated: bool = True, per_type: int | None = None) -> DataFrame:
    """``rows`` with correlation (an id of the keys' values; null if all are blank) and, by time, a sequence number in it."""
    if not set(keys) <= set(CORRELATION_KEYS) or not 0 < len(keys) <= 8:
        raise ValueError(f"correlation keys are {CORRELATION_KEYS}")
    values = [F.upper(F.trim(F.coalesce(resolve(rows, _COLUMN_OF[k]).cast("string"), F.lit("")))) for k in keys]
    blank = F.concat(*values) == ""
    out = rows.withColumn("correlation", F.when(~blank, correlation_id(*values)))
    if not keep_uncorrelated:
        out = out.where(F.col("correlation").isNotNull())
    if per_type is not None:
        arrival = Window.partitionBy("type").orderBy("time_created", "record_id")
        out = out.withColumn("_n", F.row_number().over(arrival)).where(F.col("_n") <= per_type).drop("_n")
    return out


def sequence(rows: DataFrame) -> DataFrame:
    """``rows`` with their number within the correlation, by time and record."""
    return rows.withColumn("sequence", F.row_number().over(Window.partitionBy("correlation").orderBy("time_created", "record_id")))


def groups(rows: DataFrame, most: int | None = None) -> DataFrame:
    """A row a correlation: count, first, last, duration in seconds to 3 places, sorted types, ids and computers."""
    out = rows.where("correlation IS NOT NULL").groupBy("correlation").agg(
        F.count(F.lit(1)).alias("count"), F.min("time_created").alias("first_seen"), F.max("time_created").alias("last_seen"),
        F.array_sort(F.collect_set("type")).alias("types"), F.array_sort(F.collect_set("event_id")).alias("event_ids"), F.array_sort(F.collect_set("source_computer")).alias("computers"),
    )
    out = out.withColumn("duration", F.round((F.unix_micros("last_seen") - F.unix_micros("first_seen")) / 1e6, 3))
    return out.orderBy(F.col("count").desc(), "first_seen", "correlation").limit(most) if most is not None else out


def buckets(rows: DataFrame, minutes: int) -> DataFrame:
    """Events and distinct correlations by N-minute bucket."""
    return rows.groupBy(minute_bucket(F.col("time_created"), minutes).alias("bucket")).agg(F.count(F.lit(1)).alias("count"), F.countDistinct("correlation").alias("correlations"))


def pivots(fields: Column) -> Column:
    """The distinct (kind, value) pivots of a map of fields."""
    found = [F.struct(F.lit(kind).alias("kind"), F.trim(F.element_at(fields, name)).alias("value")) for kind, names in PIVOT_FIELDS.items() for name in names]
    return F.array_distinct(F.filter(F.array(*found), lambda p: p["value"].isNotNull() & (p["value"] != "") & (p["value"] != "-")))


def investigation(observations: DataFrame, findings: DataFrame, kind: str | None = None, value: str | None = None) -> DataFrame:
    """Observations and findings (time, identity, title, fields) in one order, optionally those with a pivot."""
    side = lambda df, name: df.select("time", F.lit(name).alias("entry"), "identity", "title", pivots(F.col("fields")).alias("pivots"))
    rows = side(observations, "Observation").unionByName(side(findings, "Finding"))
    if kind is not None:
        rows = rows.where(F.exists("pivots", lambda p: (p["kind"] == kind) & (F.upper(p["value"]) == value.upper())))
    return rows.orderBy("time", "entry", "identity")


def clock_bounds(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """``rows`` (computer, time, id) with the least and greatest true time by the clock evidence that holds then.

    Evidence: computer, valid_from, valid_through, offset_low, offset_high in seconds. It is
    cut to the span of the rows and laid out over days, which make the join equal. What
    holds for a whole day is put together in one row a computer and day before it is joined;
    only evidence that begins or ends on the day itself is compared row by row.
    """
    span = rows.agg(F.min("time").alias("_from"), F.max("time").alias("_to"))  # one row
    cut = evidence.crossJoin(F.broadcast(span)).select(F.upper("computer").alias("_computer"), F.greatest("valid_from", "_from").alias("_start"), F.least("valid_through", "_to").alias("_end"), "offset_low", "offset_high").where("_start <= _end")
    daily = cut.withColumn("_day", F.explode(F.sequence(F.to_date("_start"), F.to_date("_end"))))
    first, last = F.col("_day").cast("timestamp"), F.col("_day").cast("timestamp") + F.expr("INTERVAL 86399999999 MICROSECOND")
    marked = daily.withColumn("_whole", (F.col("_start") <= first) & (F.col("_end") >= last))
    whole = marked.where("_whole").groupBy("_computer", "_day").agg(F.min("offset_low").alias("offset_low"), F.max("offset_high").alias("offset_high")).select("_computer", "_day", first.alias("_start"), last.alias("_end"), "offset_low", "offset_high")
    e = whole.unionByName(marked.where(~F.col("_whole")).drop("_whole"))
    r = rows.withColumn("_day", F.to_date("time"))
    hit = (F.upper("computer") == F.col("_computer")) & (r["_day"] == e["_day"]) & F.col("time").between(F.col("_start"), F.col("_end"))
    shift = lambda c, f: F.timestamp_micros(F.unix_micros("time") + (f(c) * 1_000_000).cast("long"))
    per = r.join(e, hit, "left").groupBy("id", "computer", "time").agg(F.min("offset_low").alias("_low"), F.max("offset_high").alias("_high"))
    return per.select("id", "computer", "time", shift("_low", F.col).alias("earliest"), shift("_high", F.col).alias("latest"))


def clock_order(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    """Before, After or Ambiguous."""
    return F.when(a_high < b_low, "Before").when(a_low > b_high, "After").otherwise("Ambiguous")


def islands(windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, start, end) windows that touch or overlap, put together."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    marked = windows.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(order))
    return marked.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def covered(wanted: DataFrame, windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``wanted`` (keys, want_start, want_end and others) with covered: whether one gap-free run of windows spans it."""
    runs = islands(windows, keys).withColumnsRenamed({"start": "_start", "end": "_end"})
    before = runs.select(*keys, F.col("_start").alias("_t"), F.lit(0).alias("_side"), "_end")
    asked = wanted.select(*keys, F.col("want_start").alias("_t"), F.lit(1).alias("_side"), F.struct(*wanted.columns).alias("_row"))
    order = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = before.unionByName(asked, allowMissingColumns=True).withColumn("_end", F.last("_end", ignorenulls=True).over(order)).where("_side = 1")
    return out.select("_row.*", F.coalesce(F.col("_end") >= F.col("_row.want_end"), F.lit(False)).alias("covered"))


def gaps(rows: DataFrame, keys: Sequence[str], longest_seconds: float) -> DataFrame:
    """Stretches between consecutive rows of a key that are longer than allowed."""
    order = Window.partitionBy(*keys).orderBy("time_created")
    out = rows.select(*keys, F.col("time_created").alias("gap_start"), F.lead("time_created").over(order).alias("gap_end"))
    return out.where((F.unix_micros("gap_end") - F.unix_micros("gap_start")) / 1e6 > longest_seconds)


def attempts(rows: DataFrame, keys: Sequence[str], starts: Column, ends: Column) -> DataFrame:
    """``rows`` with attempt: numbered sessions of a key that begin at a start phase or after an end phase."""
    order = Window.partitionBy(*keys).orderBy("time_created", "record_id")
    flagged = rows.withColumn("_begin", F.coalesce(starts, F.lit(False)) | F.coalesce(F.lag(ends).over(order), F.lit(True)))
    return flagged.withColumn("attempt", F.sum(F.col("_begin").cast("int")).over(order)).drop("_begin")


def observed_windows(rows: DataFrame) -> DataFrame:
    """(collector_computer, source_log, start, end, events): what a collection covered, by its first and last event."""
    return rows.groupBy("collector_computer", "source_log").agg(F.min("time_created").alias("start"), F.max("time_created").alias("end"), F.count(F.lit(1)).alias("events"))


def evidence_rows(findings: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows behind findings: (rule_id, event_time, position) and the columns of ``rows``, found by observation_identity."""
    wanted = findings.select("rule_id", "event_time", F.posexplode("evidence").alias("position", "observation_identity"))
    return wanted.join(rows, "observation_identity")
