"""Registered queries on report rows of every kind, evidence folders, probes, script layout and watchers that end by themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions import text
from chronolith.operators import detect, occurrences, policy, projection, reports, rules, scan, timeline, views
from chronolith.operators import predicates as p
from chronolith.plans.catalogue import _EVENTS, _folder, events, identified, policy_log, query, windows_log
from chronolith.schema import CANONICAL
from chronolith.sources import files
from chronolith.streaming import streams

_BAD = rules.Rule("bad", "An error", severity="High", confidence=80, selector=rules.Selector(types=("error",)), tags=("app", "error"))


def _found(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = identified(spark, d)
    return rows, detect.evaluate(rows, [_BAD])


@query(
    "report_findings",
    "SELECT ts AS time_created, event_id AS record_id, CAST(user_id AS VARCHAR) AS source_computer, 'An error Matched' AS message, 'bad' AS rule_id, 'High' AS severity, '80' AS confidence, '1' AS evidence_count, CAST(event_id AS VARCHAR) AS evidence, 'app, error' AS tags FROM events WHERE event_type = 'error'",
)
def _(spark, d):
    rows, found = _found(spark, d)
    part = projection.findings(found, rows, [_BAD])
    return projection.table(part).select("time_created", "record_id", "source_computer", "message", "rule_id", "severity", "confidence", "evidence_count", "evidence", "tags")


def _entries(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d)
    side = rows.select(F.col("time_created").alias("time"), F.col("record_id").cast("string").alias("identity"), F.col("type").alias("title"), F.create_map(F.lit("SourceComputer"), F.col("source_computer")).alias("fields"))
    return timeline.investigation(side, side.where("title = 'error'"))


@query(
    "report_timeline",
    _EVENTS + """, e AS (SELECT *, 'Observation' AS entry FROM c UNION ALL SELECT *, 'Finding' FROM c WHERE type = 'error')
SELECT time_created, type AS message, CAST(record_id AS VARCHAR) AS identity, entry, 'Host=' || source_computer AS pivots FROM e""",
)
def _(spark, d):
    return projection.table(projection.timeline(_entries(spark, d))).select("time_created", "message", "identity", "entry", "pivots")


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    rows, found = _found(spark, d)
    return reports.decision_metrics(rows.withColumn("received_time", F.col("time_created") + F.expr("INTERVAL 5 SECOND")), found, len(rules.BUILT_IN))


@query(
    "report_metrics",
    """SELECT metric, display_name, unit, value FROM (
SELECT 'ObservationCount' AS metric, 'Observation Count' AS display_name, 'count' AS unit, count(*)::DOUBLE AS value FROM events
UNION ALL SELECT 'AverageReceiveLagSeconds', 'Average Receive Lag Seconds', 'seconds', 5 FROM events HAVING count(*) > 0
UNION ALL SELECT 'MatchedFindingCount', 'Matched Finding Count', 'count', count(*) FROM events WHERE event_type = 'error'
UNION ALL SELECT 'TargetCount', 'Target Count', 'count', count(DISTINCT user_id) + 1 FROM events)""",
)
def _(spark, d):
    shown = projection.table(projection.metrics(_metrics(spark, d))).select("metric", "display_name", "unit", F.col("value").cast("double").alias("value"))
    return shown.where(F.col("metric").isin("ObservationCount", "AverageReceiveLagSeconds", "MatchedFindingCount", "TargetCount"))


_FIELDS = (views.DefinedField("logon_type", "Data", "logontype", "int"), views.DefinedField("account", "Data", "TargetUserName"))


@query(
    "report_typed",
    """SELECT ts AS time_created, event_id AS record_id, CAST(user_id AS VARCHAR) AS source_computer, 'DOM\\user' || user_id AS account,
CASE event_id % 4 WHEN 0 THEN 'System' WHEN 2 THEN 'Interactive' WHEN 3 THEN 'Network' END AS logon_type FROM events WHERE event_type = 'error'""",
)
def _(spark, d):
    return projection.table(projection.typed(windows_log(spark, d), "ADUserLogonFailed")).select("time_created", "record_id", "source_computer", "account", "logon_type")


@query("report_defined", "SELECT ts AS time_created, event_id AS record_id, CAST(event_id % 4 AS VARCHAR) AS logon_type, 'user' || user_id AS account FROM events WHERE event_type = 'error'")
def _(spark, d):
    part = projection.defined(windows_log(spark, d), "FailedLogon", "security", [4625], _FIELDS)
    return projection.table(part).select("time_created", "record_id", "logon_type", "account")


@query(
    "report_sections",
    """WITH n AS (SELECT count(*) AS every, count(*) FILTER (event_type = 'error') AS bad FROM events)
SELECT 'Generic' AS section, every AS rows, 'app' AS provider FROM n UNION ALL SELECT 'ADUserLogonFailed', bad, NULL FROM n UNION ALL SELECT 'FailedLogon', bad, NULL FROM n
UNION ALL SELECT 'GroupPolicyAudit', every, 'Microsoft-Windows-Security-Auditing' FROM n UNION ALL SELECT 'DetectionFinding', bad, 'app' FROM n UNION ALL SELECT 'IncidentTimeline', every + bad, NULL FROM n""",
)
def _(spark, d):
    """Six kinds of results in one table of canonical rows."""
    rows, found = _found(spark, d)
    log = windows_log(spark, d)
    parts = [
        projection.raw(rows),
        projection.typed(log, "ADUserLogonFailed"),
        projection.defined(log, "FailedLogon", "security", [4625], _FIELDS),
        projection.policies(policy.audit(policy_log(spark, d))),
        projection.findings(found, rows, [_BAD]),
        projection.timeline(_entries(spark, d)),
    ]
    return projection.report(parts).groupBy(F.col("type").alias("section"), "provider").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "sink_evidence",
    """SELECT event_type AS section, count(*) AS rows, CASE event_type WHEN 'click' THEN 'missing' WHEN 'error' THEN 'changed' WHEN 'view' THEN 'extra' END AS other_manifest, NULL::VARCHAR AS own_manifest
FROM events WHERE event_type IN ('click', 'error', 'view', 'signup') GROUP BY 1""",
)
def _(spark, d):
    """Evidence folders against their own manifest and against one that names a file more, another hash, and a file less."""
    path = _folder(spark, "evidence")
    rows = events(spark, d).select(*CANONICAL.fieldNames())
    manifest = files.write_evidence(scan.sections(rows, ["click", "error", "view", "signup"]), path)
    gone = manifest.where("section = 'click'").withColumn("file", F.concat("file", F.lit(".gone")))
    other = manifest.where("section != 'view'").withColumn("sha256", F.when(F.col("section") == "error", F.sha2("sha256", 256)).otherwise(F.col("sha256"))).unionByName(gone)
    wrong = lambda m, name: files.verify_evidence(spark, path, m).groupBy("section").agg(F.concat_ws(",", F.array_sort(F.collect_set("what"))).alias(name))
    back = spark.read.schema("section string, record_id long").json(f"{path}/data").groupBy("section").agg(F.count("record_id").alias("rows"))
    return back.join(wrong(other, "other_manifest"), "section", "left").join(wrong(None, "own_manifest"), "section", "left")


@query(
    "scan_probe",
    """WITH e AS (SELECT event_type, CASE WHEN event_type = 'signup' THEN NULL ELSE ts END AS t, value > 30 AND event_type <> 'view' AS asked FROM events),
g AS (SELECT event_type, count(*) AS all_events, count(*) FILTER (asked) AS events, max(t) FILTER (asked) AS latest FROM e GROUP BY 1)
SELECT event_type AS source_log, CASE WHEN events = 0 THEN 'NoEvent' WHEN latest IS NULL THEN 'NoUsableTimestamp' ELSE 'Ok' END AS status, latest, events, all_events FROM g
UNION ALL SELECT event_type || '-old', 'LogNotFound', NULL, 0, 0 FROM g""",
)
def _(spark, d):
    rows = events(spark, d)
    logs = rows.select(F.col("type").alias("source_log")).distinct()
    asked = (p.Field("value") > 30.0) & ~p.Field("type").in_("view")
    held = rows.withColumn("source_log", F.upper("type")).withColumn("time_created", F.when(F.col("type") != "signup", F.col("time_created")))
    return scan.probe(held, logs.union(logs.select(F.concat("source_log", F.lit("-old")))), asked)


@query(
    "fn_script_indent",
    """WITH t AS (SELECT DISTINCT text AS source, replace(replace(text, 'en', '{' || chr(10)), 'ou', chr(10) || '}') AS text FROM conversations WHERE text IS NOT NULL),
l AS (SELECT source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t),
s AS (SELECT source, i, trim(line) AS line, CASE WHEN starts_with(trim(line), '}') THEN -1 ELSE 0 END + CASE WHEN ends_with(lag(trim(line)) OVER w, '{') THEN 1 ELSE 0 END AS step FROM l WINDOW w AS (PARTITION BY source ORDER BY i)),
d AS (SELECT *, sum(step) OVER (PARTITION BY source ORDER BY i) AS depth FROM s),
r AS (SELECT *, depth - least(0, min(depth) OVER (PARTITION BY source ORDER BY i)) AS level FROM d)
SELECT md5(source) AS source_md5, md5(string_agg(repeat('    ', CAST(level AS BIGINT)) || line || chr(10), '' ORDER BY i)) AS script_md5, max(level)::BIGINT AS deepest FROM r GROUP BY source""",
)
def _(spark, d):
    """Conversations with braces and breaks put in, laid out as scripts."""
    rows = spark.read.parquet(f"{d}/conversations.parquet").where("text IS NOT NULL").select("text").distinct()
    script = F.replace(F.replace("text", F.lit("en"), F.lit("{\n")), F.lit("ou"), F.lit("\n}"))
    shown = rows.select(F.md5("text").alias("source_md5"), text.indented(script).alias("script"))
    deepest = F.array_max(F.transform(F.split("script", "\n"), lambda x: F.length(F.regexp_extract(x, "^( *)", 1)) / 4))
    return shown.select("source_md5", F.md5("script").alias("script_md5"), deepest.cast("long").alias("deepest"))


@query("stream_stop_after", "SELECT event_id AS record_id, ts AS time_created FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 25")
def _(spark, d):
    """A watcher that stops after 25 matches; started again over more files it takes none."""
    source, out = _folder(spark, "watched"), _folder(spark, "matches")
    rows = events(spark, d).select(*CANONICAL.fieldNames())
    watchers = streams.Watchers()
    for n in range(2):
        rows.withColumn("time_created", F.col("time_created") + F.expr(f"INTERVAL {n} DAYS")).write.mode("append").parquet(source)
        found = spark.readStream.schema(CANONICAL).parquet(source).where("type = 'error'")
        start = lambda found=found: streams.first_matches(found, f"{out}/rows", f"{out}/at", 25, availableNow=True)
        watchers.start("errors", start, timeout=600, enough=lambda: streams.taken(spark, f"{out}/rows") >= 25)
        if (ended := watchers.wait()["errors"]) not in ("enough", "ended"):
            raise RuntimeError(f"the watcher {ended}")
    return spark.read.parquet(f"{out}/rows").select("record_id", "time_created")


_PARTS = "WITH f AS (SELECT conv_id, turn + 1 AS n, (SELECT max(turn) + 1 FROM conversations c WHERE c.conv_id = x.conv_id) AS total FROM conversations x WHERE turn >= 0 AND (conv_id + turn * 7) % 5 <> 0)"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as scripts of which about every fifth part was lost."""
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    total = turns.groupBy("conv_id").agg((F.max("turn") + 1).alias("message_total"))
    kept = turns.where("turn >= 0 AND (conv_id + turn * 7) % 5 <> 0").join(total, "conv_id")
    return kept.select(F.col("conv_id").alias("script_block_id"), (F.col("turn") + 1).alias("message_number"), "message_total", F.col("text").alias("script_block_text"))


@query(
    "occ_incomplete",
    _PARTS + """, g AS (SELECT conv_id, max(total) AS total, count(DISTINCT n) AS parts, list(DISTINCT n) AS held FROM f GROUP BY 1)
SELECT conv_id AS script_block_id, parts, total AS message_total, total - parts AS missing, list_min(list_filter(range(1, total + 1), lambda x: NOT list_contains(held, x))) AS first_missing FROM g WHERE total > parts""",
)
def _(spark, d):
    return occurrences.incomplete(_parts(spark, d))


@query(
    "occ_script_bounds",
    _PARTS + """, g AS (SELECT conv_id, max(total) AS total, count(DISTINCT n) AS parts FROM f GROUP BY 1)
SELECT * FROM (SELECT 'scripts' AS bound, count(*) AS value, 3::BIGINT AS allowed FROM g UNION ALL SELECT 'pending', count(*), 2 FROM g WHERE total > parts UNION ALL SELECT 'parts', coalesce(max(parts), 0), 4 FROM g) WHERE value > allowed""",
)
def _(spark, d):
    return occurrences.script_bounds(_parts(spark, d), 3, 2, 4)
