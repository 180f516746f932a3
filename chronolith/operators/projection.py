"""Report rows: every kind of result as canonical rows of one section, so that they can be exported, kept private, filtered and stored alike.

A section is a name, a title, and columns (name, title, type) that stand in the payload as
text. Seven kinds are known: raw rows, rows of a typed view, rows of a user's definition,
policy changes, findings, timeline entries and metrics. All of them are plain projections;
only findings are joined, with the observation that is their first evidence.

Defined cases: a value that is null is left out of the payload; a finding whose first
evidence is not among the observations keeps its own columns and has null common ones;
without observations no time but the finding's own is known; empty inputs give empty
sections, whose columns are still described.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions.text import snake_case
from chronolith.operators import views
from chronolith.operators.rules import Rule
from chronolith.schema import CANONICAL, canonical


@dataclass(frozen=True)
class Section:
    """Report rows of one kind: canonical rows, and the columns that their payload holds."""

    name: str
    title: str
    columns: tuple[tuple[str, str, str], ...]  # name, title, type
    rows: DataFrame


def _title(name: str) -> str:
    return snake_case(name).replace("_", " ").capitalize()


def _text(column: Column, kind: str) -> Column:
    """A value as text: lists by ', ', pairs as key=value."""
    if kind.startswith("array<struct"):
        return F.array_join(F.transform(column, lambda e: F.concat(e.getField("kind"), F.lit("="), F.coalesce(e.getField("value"), F.lit("")))), ", ")
    return F.array_join(column, ", ") if kind.startswith("array") else column.cast("string")


def section(rows: DataFrame, name: str, title: str, fields: Sequence[str]) -> Section:
    """``rows`` with common columns of their own, and ``fields`` gathered in the payload."""
    kinds = dict(rows.dtypes)
    cells = [F.struct(F.lit(f).alias("key"), _text(F.col(f"`{f}`"), kinds[f]).alias("value")) for f in fields]
    payload = F.map_from_entries(F.filter(F.array(*cells), lambda e: e["value"].isNotNull()))
    common = [c for c in rows.columns if c in CANONICAL.fieldNames() and c not in ("type", "values")]
    made = rows.select(*common, F.lit(name).alias("type"), payload.alias("values"))
    return Section(name, title, tuple((f, _title(f), kinds[f]) for f in fields), canonical(made))


def raw(rows: DataFrame, keys: Sequence[str] = ()) -> Section:
    """Events as they are. ``keys`` are the payload keys that the section shows as columns."""
    return Section("Generic", "Events", tuple((k, _title(k), "string") for k in keys), canonical(rows).withColumn("type", F.lit("Generic")))


def typed(rows: DataFrame, view: str) -> Section:
    """The rows of a typed view with the view's own columns."""
    found = views.projected(rows, view)
    own = [c for c in found.columns if c not in ("record_id", "details")]
    return section(found.withColumn("time_created", F.col("time")).withColumn("source_computer", F.col("computer")), view, _title(view), own)


def defined(rows: DataFrame, name: str, log: str, event_ids: Sequence[int], fields: Sequence[views.DefinedField]) -> Section:
    """The rows of a user's definition."""
    return section(views.defined(rows, log, event_ids, fields), name, _title(name), [f.name for f in fields])


def policies(audited: DataFrame) -> Section:
    """The changes of ``policy.audit``."""
    rows = audited.withColumn("time_created", F.col("at")).withColumn("provider", F.lit("Microsoft-Windows-Security-Auditing"))
    return section(rows, "GroupPolicyAudit", "Group policy changes", [c for c in audited.columns if c not in ("record_id", "source_computer", "at")])


_RULE = "rule_id string, title string, severity string, confidence int, tags array<string>"


def findings(found: DataFrame, observations: DataFrame | None = None, rules: Sequence[Rule] = ()) -> Section:
    """Findings with what is known of their rules; the common columns are those of the first evidence.

    Findings are the smaller side, so only they and the observations that they name are
    shuffled; the rules, a row each, are broadcast.
    """
    spark = found.sparkSession
    known = spark.createDataFrame([(r.rule_id, r.title, r.severity, r.confidence, list(r.tags)) for r in rules], _RULE)
    bare = found.drop("title", "severity", "confidence", "tags", *[c for c in CANONICAL.fieldNames() if c in found.columns])
    rows = bare.withColumn("evidence_count", F.size("evidence").cast("long")).join(F.broadcast(known), "rule_id", "left").withColumn("observation_identity", F.get("evidence", F.lit(0)))
    if observations is not None:
        common = [c for c in CANONICAL.fieldNames() if c not in ("type", "values", "message", "time_created", "observation_identity")]
        seen = canonical(observations).join(rows.select("observation_identity").distinct(), "observation_identity", "left_semi")
        first = seen.groupBy("observation_identity").agg(F.min(F.struct("time_created", *common)).alias("_first"))  # an identity that comes twice is its earliest row
        rows = rows.join(first, "observation_identity", "left").select("*", *[F.col(f"_first.{c}").alias(c) for c in common]).drop("_first")
    rows = rows.withColumn("time_created", F.col("event_time")).withColumn("message", F.concat_ws(" ", F.coalesce("title", "rule_id"), F.col("status")))
    fields = ["rule_id", "title", "severity", "confidence", "status", "group_value", "event_time", "evidence_count", "evidence", "tags"]
    return section(rows, "DetectionFinding", "Findings", fields + [c for c in ("entities", "note") if c in found.columns])


def timeline(entries: DataFrame) -> Section:
    """The entries of ``timeline.investigation``."""
    rows = entries.withColumn("time_created", F.col("time")).withColumn("message", F.col("title")).withColumn("observation_identity", F.col("identity"))
    return section(rows, "IncidentTimeline", "Timeline", ["entry", "identity", "title", "time", "pivots"])


#: The unit of a metric, by the end of its name.
_UNITS = (("Seconds", "seconds"), ("Rate", "a second"), ("Count", "count"))


def metrics(values: DataFrame) -> Section:
    """Metrics (metric, value) with a title and a unit; they belong to no time."""
    unit = reduce(lambda rest, u: F.when(F.col("metric").endswith(u[0]), u[1]).otherwise(rest), reversed(_UNITS), F.lit("count"))
    words = F.trim(F.regexp_replace("metric", r"(?<=[a-z0-9])(?=[A-Z])", " "))
    rows = values.withColumn("display_name", words).withColumn("unit", unit).withColumn("message", words)
    return section(rows, "DecisionMetric", "Decision metrics", ["metric", "display_name", "value", "unit"])


def report(sections: Sequence[Section]) -> DataFrame:
    """All sections in one table of canonical rows; their type names the section."""
    return reduce(DataFrame.unionByName, [s.rows for s in sections])


def described(sections: Sequence[Section]) -> list[tuple[str, str, str, str, str, int]]:
    """(section, section title, column, column title, type, place) of every payload column."""
    return [(s.name, s.title, *c, n) for s in sections for n, c in enumerate(s.columns)]


def table(part: Section) -> DataFrame:
    """A section laid out again: common columns that are not always null by kind, then each payload column by its name."""
    return part.rows.select("time_created", "record_id", "source_computer", "message", *[F.element_at("values", n).alias(n) for n, _, _ in part.columns])
