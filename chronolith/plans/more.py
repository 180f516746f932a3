"""More registered queries: stateful rules, Sigma, views, privacy, files, the store and streams, each with its SQL."""

from __future__ import annotations

import hashlib
import hmac
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions import decode, text, times
from chronolith.operators import aggregate as agg
from chronolith.operators import detect, enrich, occurrences, privacy, reports, rules, scan, sigma, timeline, views
from chronolith.operators import predicates as p
from chronolith.plans.catalogue import _EVENTS, _folder, _steps, events, identified, query, windows_log
from chronolith.schema import canonical, from_app_events, payload
from chronolith.scratch import written
from chronolith.sources import files, store
from chronolith.streaming import ordered, streams

# Stateful rules. The state of a group is a row of a recursive query; evidence shows as one text.


def _shown(found: DataFrame) -> DataFrame:
    return found.select("rule_id", "group_value", "status", "event_time", F.array_join("evidence", ",").alias("evidence"))


_NUMBERED = "SELECT user_id, event_id AS id, epoch_us(ts) AS t, event_type AS type, json_extract_string(props, '$.k') AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ({types})"
_FOUND = "SELECT '{rule}' AS rule_id, CAST(user_id AS VARCHAR) AS group_value, 'Matched' AS status, make_timestamp(t) AS event_time, array_to_string(evidence, ',') AS evidence FROM s WHERE len(evidence) > 0"


def _distinct_sql() -> str:
    item = "{'v': e.k, 't': e.t, 'id': e.id}"
    held = f"list_append(list_filter(s.held, lambda y: y.v <> e.k AND y.t >= e.t - 432000000000), {item})"
    return (
        f"WITH RECURSIVE e AS ({_NUMBERED.format(types=chr(39) + 'click' + chr(39))}),"
        f"s AS (SELECT user_id, n, t, [{item}] AS held, CAST([] AS BIGINT[]) AS evidence FROM e WHERE n = 1 UNION ALL "
        "SELECT user_id, n, t, CASE WHEN len(x) >= 3 THEN [] ELSE x END, CASE WHEN len(x) >= 3 THEN list_transform(x, lambda y: y.id) ELSE [] END "
        f"FROM (SELECT e.user_id, e.n, e.t, {held} AS x FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)) " + _FOUND.format(rule="ks")
    )


@query("detect_distinct", _distinct_sql())
def _(spark, d):
    rule = rules.Rule("ks", kind="DistinctValue", selector=rules.Selector(types=("click",)), threshold=3, window_seconds=432000, group_by="source_computer", distinct_by="k")
    return _shown(detect.evaluate(identified(spark, d), [rule]))


_STEP_TYPES = ("view", "click", "purchase")
_STEP_WINDOW = 259_200_000_000


def _temporal_sql() -> str:
    own = lambda i, t: f"list_slice(CASE WHEN e.type = '{t}' THEN list_append(list_filter(s.h{i}, lambda y: y.t >= e.t - {_STEP_WINDOW}), {{'t': e.t, 'id': e.id}}) ELSE list_filter(s.h{i}, lambda y: y.t >= e.t - {_STEP_WINDOW}) END, -3, -1) AS h{i}"
    full = "len(h0) > 0 AND len(h1) > 0 AND len(h2) > 0"
    return (
        f"WITH RECURSIVE e AS ({_NUMBERED.format(types=', '.join(repr(t) for t in _STEP_TYPES))}),"
        "s AS (SELECT user_id, n, t, " + ", ".join(f"CASE WHEN type = '{t}' THEN [{{'t': t, 'id': id}}] ELSE [] END AS h{i}" for i, t in enumerate(_STEP_TYPES)) + ", CAST([] AS BIGINT[]) AS evidence FROM e WHERE n = 1 UNION ALL "
        "SELECT user_id, n, t, " + ", ".join(f"CASE WHEN {full} THEN [] ELSE h{i} END" for i in range(3)) + f", CASE WHEN {full} THEN list_transform(list_sort([h0[1], h1[1], h2[1]]), lambda y: y.id) ELSE [] END FROM (SELECT e.user_id, e.n, e.t, "
        + ", ".join(own(i, t) for i, t in enumerate(_STEP_TYPES)) + " FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)) " + _FOUND.format(rule="any")
    )


@query("detect_temporal", _temporal_sql())
def _(spark, d):
    return _shown(detect.evaluate(identified(spark, d), [rules.Rule("any", kind="Temporal", steps=_steps(*_STEP_TYPES), window_seconds=259200, group_by="source_computer")]))


def _ordered_sql() -> str:
    live = lambda c: f"CASE WHEN s.{c}.t >= e.t - {_STEP_WINDOW} THEN s.{c} END"
    return (
        f"WITH RECURSIVE e AS ({_NUMBERED.format(types=', '.join(repr(t) for t in _STEP_TYPES))}),"
        "s AS (SELECT user_id, n, t, CASE WHEN type = 'view' THEN {'t': t, 'a': id} END AS p, CAST(NULL AS STRUCT(t BIGINT, a BIGINT, b BIGINT)) AS q, CAST([] AS BIGINT[]) AS evidence FROM e WHERE n = 1 UNION ALL "
        "SELECT user_id, n, t, CASE WHEN type = 'purchase' AND q IS NOT NULL THEN NULL WHEN type = 'view' THEN {'t': t, 'a': id} ELSE p END, "
        "CASE WHEN type = 'purchase' AND q IS NOT NULL THEN NULL WHEN type = 'click' AND p IS NOT NULL AND (q IS NULL OR q.t < p.t) THEN {'t': p.t, 'a': p.a, 'b': id} ELSE q END, "
        "CASE WHEN type = 'purchase' AND q IS NOT NULL THEN [q.a, q.b, id] ELSE [] END "
        f"FROM (SELECT e.user_id, e.n, e.t, e.type, e.id, {live('p')} AS p, {live('q')} AS q FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)) " + _FOUND.format(rule="order")
    )


@query("detect_ordered", _ordered_sql())
def _(spark, d):
    return _shown(detect.evaluate(identified(spark, d), [rules.Rule("order", kind="OrderedTemporal", steps=_steps(*_STEP_TYPES), window_seconds=259200, group_by="source_computer")]))


_ABSENCE = f"""WITH RECURSIVE e AS ({_NUMBERED.format(types="'signup', 'purchase'")}),
s AS (SELECT user_id, n, CASE WHEN type = 'signup' THEN [{{'t': t, 'id': id}}] ELSE [] END AS open, CAST([] AS STRUCT(t BIGINT, id BIGINT)[]) AS due FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.n, CASE WHEN e.type = 'purchase' THEN list_slice(left_, 2, len(left_)) ELSE list_append(left_, {{'t': e.t, 'id': e.id}}) END, due_
FROM (SELECT e.*, list_filter(s.open, lambda y: y.t + {_STEP_WINDOW} > e.t) AS left_, list_filter(s.open, lambda y: y.t + {_STEP_WINDOW} <= e.t) AS due_ FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1) e),
f AS (SELECT user_id, unnest(due) AS x FROM s UNION ALL SELECT user_id, unnest(open) FROM (SELECT user_id, arg_max(open, n) AS open FROM s GROUP BY 1))
SELECT 'silent' AS rule_id, CAST(user_id AS VARCHAR) AS group_value, CASE WHEN x.t + {_STEP_WINDOW} <= (SELECT max(epoch_us(ts)) FROM events) THEN 'Matched' ELSE 'Incomplete' END AS status,
       make_timestamp(x.t + {_STEP_WINDOW}) AS event_time, CAST(x.id AS VARCHAR) AS evidence FROM f"""


@query("detect_absence", _ABSENCE)
def _(spark, d):
    return _shown(detect.evaluate(identified(spark, d), [rules.Rule("silent", kind="Absence", steps=_steps("signup", "purchase"), window_seconds=259200, group_by="source_computer")]))


@query("detect_group_key", "SELECT 'all' AS rule_id, '*' AS group_value, count(*) // 50 AS findings FROM events WHERE event_type = 'error' UNION ALL SELECT 'lack', NULL, 1")
def _(spark, d):
    """A rule without a group holds all rows in one; a group field that rows lack gives one Incomplete finding."""
    made = [rules.Rule("all", kind="Threshold", selector=rules.Selector(types=("error",)), threshold=50, window_seconds=86400 * 365), rules.Rule("lack", kind="Threshold", selector=rules.Selector(types=("error",)), threshold=2, window_seconds=60, group_by="nothing")]
    return detect.evaluate(identified(spark, d), made).groupBy("rule_id", "group_value").agg(F.count(F.lit(1)).alias("findings"))


@query("detect_tuned", "SELECT 'bad' AS rule_id, 'Critical' AS severity, event_id AS record_id FROM events WHERE event_type = 'error' AND value > 50")
def _(spark, d):
    base = [rules.Rule("bad", title="Errors", selector=rules.Selector(types=("error",), predicate=p.Field("value") > 50)), rules.Rule("off", selector=rules.Selector(types=("view",)))]
    made = rules.tuned(base, [rules.Tuning("BAD", severity="Critical"), rules.Tuning("off", disabled=True)])
    return detect.described(detect.evaluate(identified(spark, d), made), made).select("rule_id", "severity", F.get("evidence", F.lit(0)).cast("long").alias("record_id"))


@query("detect_described", "SELECT 'bad' AS rule_id, 'Errors' AS title, 'High' AS severity, 90 AS confidence, 'a,b' AS tags, CAST(user_id AS VARCHAR) AS computer, count(*) AS findings FROM events WHERE event_type = 'error' GROUP BY user_id")
def _(spark, d):
    """Findings with what their rule says and the entities that their evidence names."""
    made = [rules.Rule("bad", "Errors", severity="High", confidence=90, selector=rules.Selector(types=("error",)), tags=("a", "b"))]
    rows = identified(spark, d)
    found = detect.entities(detect.described(detect.evaluate(rows, made), made), rows)
    return found.select("*", F.explode(F.filter("entities", lambda e: e["kind"] == "Host")).alias("e")).where("e.value <> 'collector'").groupBy("rule_id", "title", "severity", "confidence", F.array_join("tags", ",").alias("tags"), F.col("e.value").alias("computer")).agg(F.count(F.lit(1)).alias("findings"))


@query("detect_candidates", "SELECT 'candidates' AS bound, 3::BIGINT AS value, 2::BIGINT AS allowed")
def _(spark, d):
    made = [rules.Rule(f"r{i}", selector=rules.Selector(types=("error",))) for i in range(3)]
    return detect.bounds(identified(spark, d), made, max_candidates=2, max_observations=10**9)


@query("detect_evidence_rows", "SELECT 'bad' AS rule_id, event_id AS record_id, value FROM events WHERE event_type = 'error' AND value > 90")
def _(spark, d):
    rows = identified(spark, d)
    found = detect.evaluate(rows, [rules.Rule("bad", selector=rules.Selector(types=("error",), predicate=p.Field("value") > 90))])
    return timeline.evidence_rows(found, rows).select("rule_id", "record_id", "value")


@query("detect_pack_round_trip", "SELECT 'bad' AS rule_id, event_id AS record_id FROM events WHERE event_type = 'error' UNION ALL SELECT 'views', event_id FROM events WHERE event_type = 'view' AND value < 5")
def _(spark, d):
    """A signed pack written and read again gives the findings of its rules; so does its plan's hash."""
    key = b"k" * 32
    pack = rules.Pack("mine", "1.0.0", (rules.Rule("bad", selector=rules.Selector(types=("error",))), rules.Rule("views", selector=rules.Selector(types=("view",), predicate=p.Field("value") < 5))))
    back = rules.Pack.from_json(pack.to_json(key), key)
    if rules.plan_hash(back.rules) != rules.plan_hash(pack.rules) or rules.compare_packs(pack, back) != {"added": [], "removed": [], "changed": []}:
        raise ValueError("a pack changed on its way")
    return detect.evaluate(identified(spark, d), back.rules).select("rule_id", F.get("evidence", F.lit(0)).cast("long").alias("record_id"))


@query("detect_builtin_packs", "SELECT rule_id, count(*) AS findings FROM (SELECT 'EVENTING-0001' AS rule_id FROM events WHERE event_type = 'error' UNION ALL SELECT 'EVENTING-0003' FROM events WHERE event_type = 'view' UNION ALL SELECT 'GOVERNANCE-0003' FROM events WHERE event_type = 'signup') GROUP BY 1")
def _(spark, d):
    named = F.when(F.col("type") == "error", "LogsClearedSecurity").when(F.col("type") == "view", "AuditPolicyChange").when(F.col("type") == "signup", "CertificateIssued").otherwise("none")
    made = [r for pack in rules.BUILT_IN for r in pack.rules if r.kind == "Stateless"]
    return detect.evaluate(canonical(identified(spark, d).withColumn("type", named)), made).groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"))


@query("detect_pack_coverage", "SELECT count(DISTINCT CASE WHEN event_type = 'error' THEN 'a' END) + count(DISTINCT CASE WHEN event_type = 'click' THEN 'b' END) AS seen, 46 AS needed FROM events")
def _(spark, d):
    """Which of the types that the built-in rules need were observed: two of them, under other names of case."""
    named = F.when(F.col("type") == "error", "LOGSCLEAREDSECURITY").when(F.col("type") == "click", "certificateissued").otherwise("none")
    out = detect.coverage(rules.BUILT_IN, events(spark, d).select(named.alias("type")))
    return out.agg(F.count_if("observed").alias("seen"), F.count(F.lit(1)).cast("int").alias("needed"))


@query("detect_new_requirements", "SELECT 'b' AS rule_id, 'click' AS type, true AS observed UNION ALL SELECT 'b', 'never', false")
def _(spark, d):
    """What a new version of a pack needs beyond the old one, and whether it is observed."""
    old = rules.Pack("p", "1", (rules.Rule("a", selector=rules.Selector(types=("error",))),))
    new = rules.Pack("p", "2", (*old.rules, rules.Rule("b", selector=rules.Selector(types=("click", "never")))))
    seen = events(spark, d).select("type")
    return scan.missing(detect.coverage([new], seen), detect.coverage([old], seen), ["rule_id", "type"])


# Sigma

_SIGMA = [
    {"title": "bad", "name": "bad", "id": "s-1", "logsource": {"product": "windows", "service": "application"}, "detection": {"sel": {"type": "error"}, "high": {"value|re": "^9"}, "low": {"k|startswith": "1"}, "condition": "sel and (high or low)"}, "level": "high"},
    {"title": "any", "name": "any", "id": "s-2", "logsource": {"service": "application"}, "detection": {"sel": {"type|contains": "rro"}, "condition": "sel"}},
    {"title": "many", "id": "s-3", "correlation": {"type": "event_count", "rules": "any", "group-by": "source_computer", "timespan": "5d", "condition": {"gte": 3}}},
    {"title": "refused", "id": "s-4", "logsource": {"service": "application"}, "detection": {"sel": {"type|base64": "x"}, "condition": "sel"}},
]


@query("sigma_rule", _EVENTS + "SELECT 's-1' AS rule_id, record_id FROM c WHERE type = 'error' AND (CAST(value AS VARCHAR) LIKE '9%' OR k LIKE '1%')")
def _(spark, d):
    made, refused = sigma.compile_documents(_SIGMA)
    if [i for i, _ in refused] != ["s-4"]:
        raise ValueError("a document that cannot be said exactly must be refused")
    found = detect.evaluate(identified(spark, d), [r for r in made if r.rule_id == "s-1"])
    return found.select("rule_id", F.get("evidence", F.lit(0)).cast("long").alias("record_id"))


_THRESHOLD = f"""WITH RECURSIVE e AS ({_NUMBERED.format(types="'error'")}),
s AS (SELECT user_id, n, t, [{{'t': t, 'id': id}}] AS held, CAST([] AS BIGINT[]) AS evidence FROM e WHERE n = 1
UNION ALL SELECT user_id, n, t, CASE WHEN len(x) >= 3 THEN [] ELSE x END, CASE WHEN len(x) >= 3 THEN list_transform(x, lambda y: y.id) ELSE [] END
FROM (SELECT e.user_id, e.n, e.t, list_append(list_filter(s.held, lambda y: y.t >= e.t - 432000000000), {{'t': e.t, 'id': e.id}}) AS x FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)) """


@query("sigma_correlation", _THRESHOLD + _FOUND.format(rule="s-3"))
def _(spark, d):
    made, _ = sigma.compile_documents(_SIGMA)
    return _shown(detect.evaluate(identified(spark, d), [r for r in made if r.rule_id == "s-3"]))


@query("sigma_patterns", "SELECT p_partkey FROM part WHERE regexp_full_match(lower(p_type), '.*e.') OR lower(p_brand) = 'brand#13' OR contains(p_name, '*')")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet")
    some = [p.compare(field, *sigma.pattern(t)) for field, t in (("p_type", "*e?"), ("p_brand", "BRAND#13"), ("p_name", r"*\**"))]
    return p.where(rows, p.any_of(*some)).select("p_partkey")


# Occurrences and time

@query("occ_semantic", """WITH RECURSIVE e AS (SELECT user_id, json_extract_string(props, '$.k') AS k, ts, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY ts) AS n FROM events),
s AS (SELECT user_id, k, n, ts, t AS first FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.k, e.n, e.ts, CASE WHEN e.t - s.first <= 36000000000 THEN s.first ELSE e.t END FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k AND e.n = s.n + 1)
SELECT count(*) AS rows, min(ts) AS first_seen FROM s GROUP BY user_id, k, first""")
def _(spark, d):
    rows = events(spark, d).withColumn("values", F.create_map(F.lit("CorrelationId"), F.col("k")))
    return occurrences.semantic(rows, 36_000).groupBy("occurrence").agg(F.count(F.lit(1)).alias("rows"), F.min("time_created").alias("first_seen")).drop("occurrence")


@query("occ_representative", "SELECT event_id AS record_id, CASE WHEN event_id % 3 = 0 THEN 'ForwardedEvents' ELSE 'Application' END AS container_log, 2::BIGINT AS copies FROM events")
def _(spark, d):
    """Of two copies that with more evidence counts, else the direct one."""
    rows = events(spark, d).withColumn("collector_computer", F.col("source_computer"))
    more = F.when(F.col("record_id") % 3 == 0, F.map_concat("values", F.create_map(F.lit("more"), F.lit("x")))).otherwise(F.col("values"))
    sent = rows.withColumn("container_log", F.lit("ForwardedEvents")).withColumn("collector_computer", F.lit("hub")).withColumn("values", more)
    return occurrences.representative(occurrences.transport(sent.unionByName(rows))).select("record_id", "container_log", "copies")


@query("occ_unkeyed", "SELECT count(*) * 2 AS occurrences FROM events")
def _(spark, d):
    """Rows with a blank computer stay single, copies too."""
    rows = events(spark, d).withColumn("source_computer", F.lit(" "))
    sent = rows.withColumn("container_log", F.lit("ForwardedEvents"))
    return occurrences.transport(rows.unionByName(sent)).agg(F.countDistinct("occurrence").alias("occurrences"))


@query("occ_bounds", "SELECT 'observations' AS bound, 101::BIGINT AS value, 100::BIGINT AS allowed UNION ALL SELECT 'groups', 51, 50")
def _(spark, d):
    rows = events(spark, d)
    return occurrences.bounds(rows, occurrences.transport(rows), 100, 50)


@query("time_investigation", "SELECT event_id AS identity, 'Observation' AS entry FROM events WHERE user_id = 7 UNION ALL SELECT event_id, 'Finding' FROM events WHERE user_id = 7 AND event_type = 'error'")
def _(spark, d):
    rows = events(spark, d)
    side = rows.select(F.col("time_created").alias("time"), F.col("record_id").alias("identity"), F.col("type").alias("title"), F.create_map(F.lit("SourceComputer"), F.col("source_computer")).alias("fields"))
    return timeline.investigation(side, side.where("title = 'error'"), "Host", "7").select("identity", "entry")


@query("time_group_limit", _EVENTS + "SELECT type AS who, source_computer, count(*) AS count FROM c GROUP BY 1, 2 ORDER BY count DESC, min(time_created) LIMIT 20")
def _(spark, d):
    rows = events(spark, d).withColumn("values", F.create_map(F.lit("Who"), F.col("type")))
    g = timeline.groups(timeline.correlate(rows, ("who", "computer")), 20)
    return g.select(F.get("types", F.lit(0)).alias("who"), F.get("computers", F.lit(0)).alias("source_computer"), "count")


@query("time_clock_order", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 + 2 < 4 THEN 'Before' WHEN o_orderkey % 7 > 5 THEN 'After' ELSE 'Ambiguous' END AS shown FROM orders")
def _(spark, d):
    low = F.col("o_orderkey") % 7
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", timeline.clock_order(low, low + 2, F.lit(4), F.lit(5)).alias("shown"))


@query("agg_bucket_labels", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') || ' +00:00' AS label FROM orders")
def _(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select(times.bucket_label(F.date_trunc("DAY", F.col("o_orderdate").cast("timestamp")), "Day").alias("label")).distinct()


@query("agg_zone_ends", _EVENTS + """, b AS (SELECT date_trunc('day', timezone('Europe/Berlin', timezone('UTC', time_created))) AS l, count(*) AS count FROM c GROUP BY 1)
SELECT timezone('UTC', timezone('Europe/Berlin', l)) AS bucket_start, timezone('UTC', timezone('Europe/Berlin', l + INTERVAL 1 DAY)) AS bucket_end, count FROM b""")
def _(spark, d):
    return agg.aggregate(events(spark, d), agg.Definition((), bucket="Day", zone="Europe/Berlin"))


@query("report_user_logons", """WITH f AS (SELECT *, 'user' || user_id AS u, CASE event_id % 4 WHEN 0 THEN 'System' WHEN 1 THEN '1' WHEN 2 THEN 'Interactive' ELSE 'Network' END AS lt FROM events WHERE event_type IN ('error', 'click')),
r AS (SELECT 'computer' AS dimension, CAST(user_id AS VARCHAR) AS value FROM f UNION ALL SELECT 'event_id', CASE event_type WHEN 'click' THEN '4624' ELSE '4625' END FROM f UNION ALL SELECT 'user', u FROM f UNION ALL SELECT 'domain', 'DOM' FROM f
UNION ALL SELECT 'logon_type', lt FROM f UNION ALL SELECT 'ip', CASE WHEN event_id % 3 = 0 THEN NULL ELSE '10.0.0.1' END FROM f) SELECT dimension, value, count(*) AS count FROM r WHERE value IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    return reports.user_logons(windows_log(spark, d))


@query("report_rc4_bound", "SELECT 'groups' AS bound, 51::BIGINT AS value, 50::BIGINT AS allowed")
def _(spark, d):
    rows = identified(spark, d).withColumn("event_id", (F.lit(201) + F.col("record_id") % 9).cast("int")).withColumn("provider", F.lit("Kdcsvc")).withColumn("source_log", F.lit("System"))
    return reports.rc4_bound(rows, 50)


@query("report_samples", "SELECT event_id AS record_id FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 25")
def _(spark, d):
    return reports.samples(events(spark, d).where("type = 'error'"), 25).select("record_id")


# Predicates and scans

_PERIODS = ("PastHour", "CurrentHour", "PastDay", "CurrentDay", "Today", "Yesterday", "PastMonth", "CurrentMonth", "PastQuarter", "CurrentQuarter", "Everything", "Last3Days", "Last7Days", "Last14Days", "Last1Hour", "Last2Hours", "Last6Hours", "Last24Hours", "Last30Minutes", "TillLastMonday", "TillLastSunday")
_NOW = "TIMESTAMP '2024-01-17 13:30:00'"
_STARTS = {
    "PastHour": ("2024-01-17 12:00", "2024-01-17 13:00"), "CurrentHour": ("2024-01-17 13:00", "2024-01-17 14:00"), "PastDay": ("2024-01-16", "2024-01-17"), "CurrentDay": ("2024-01-17", "2024-01-18"), "Today": ("2024-01-17", "2024-01-18"), "Yesterday": ("2024-01-16", "2024-01-17"),
    "PastMonth": ("2023-12-01", "2024-01-01"), "CurrentMonth": ("2024-01-01", "2024-02-01"), "PastQuarter": ("2023-10-01", "2024-01-01"), "CurrentQuarter": ("2024-01-01", "2024-04-01"), "Everything": ("1900-01-01", "2100-01-01"), "Last3Days": ("2024-01-14", "2100-01-01"),
    "Last7Days": ("2024-01-10", "2100-01-01"), "Last14Days": ("2024-01-03", "2100-01-01"), "Last1Hour": ("2024-01-17 12:30", "2024-01-17 13:30:00.000001"), "Last2Hours": ("2024-01-17 11:30", "2024-01-17 13:30:00.000001"), "Last6Hours": ("2024-01-17 07:30", "2024-01-17 13:30:00.000001"),
    "Last24Hours": ("2024-01-16 13:30", "2024-01-17 13:30:00.000001"), "Last30Minutes": ("2024-01-17 13:00", "2024-01-17 13:30:00.000001"), "TillLastMonday": ("2024-01-15", "2100-01-01"), "TillLastSunday": ("2024-01-14", "2100-01-01"),
}


@query("scan_periods", "SELECT v.name, count(e.ts) AS events FROM (VALUES " + ", ".join(f"('{n}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for n, (a, b) in _STARTS.items()) + ") v(name, a, b) LEFT JOIN events e ON e.ts >= v.a AND e.ts < v.b GROUP BY 1")
def _(spark, d):
    rows, now = events(spark, d), datetime(2024, 1, 17, 13, 30)
    counts = rows.agg(*[F.count_if(times.in_period(F.col("time_created"), n, now)).alias(n) for n in _PERIODS])
    return counts.select(F.explode(F.create_map(*[x for n in _PERIODS for x in (F.lit(n), F.col(n))])).alias("name", "events"))


@query("scan_forwarded", "SELECT event_id AS record_id FROM events WHERE event_type = 'error' AND event_id % 2 = 0")
def _(spark, d):
    """What a collector holds for the failed-logon view of other computers."""
    rows = windows_log(spark, d).withColumn("container_log", F.when(F.col("record_id") % 2 == 0, "forwardedevents").otherwise("Security"))
    return scan.forwarded(rows, views.sources(["ADUserLogonFailed"])).select("record_id")


@query("scan_raw_order", "SELECT event_id AS record_id, row_number() OVER (ORDER BY ts, event_id) AS place FROM events QUALIFY place <= 300")
def _(spark, d):
    first = scan.raw_order(events(spark, d)).limit(300)
    return first.select("record_id", F.row_number().over(timeline.Window.orderBy("time_created", "record_id")).alias("place"))


@query("scan_sections", "SELECT event_type AS section, count(*) AS rows FROM events WHERE event_type IN ('error', 'view') GROUP BY 1")
def _(spark, d):
    parts = scan.sections(events(spark, d), ["error", "view"])
    made = [rows.agg(F.lit(name).alias("section"), F.count(F.lit(1)).alias("rows")) for name, rows in parts.items()]
    return made[0].unionByName(made[1])


@query("scan_missing_pairs", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000 AND o_orderkey % 3 = 0)")
def _(spark, d):
    customer, orders = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "orders"))
    orders = orders.where("o_totalprice > 100000 AND o_orderkey % 3 = 0")
    return scan.missing(customer.select("c_custkey"), orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("pred_keyword_mask", "SELECT p_partkey FROM part WHERE p_partkey & 5 <> 0")
def _(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").where(decode.mask_matches(F.col("p_partkey"), 1, 4)).select("p_partkey")


@query("pred_contains_all", "SELECT doc_id FROM documents WHERE contains(upper(text), 'TH') AND contains(upper(text), 'LICENSE')")
def _(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").where(text.contains_all(F.col("text"), "th", "license")).select("doc_id")


@query("pred_callback", "SELECT event_id AS record_id FROM events WHERE event_type = 'error' AND value > 50")
def _(spark, d):
    return enrich.keep(events(spark, d).select("record_id", "type", "value"), F.col("type") == "error", lambda pdf: pdf["value"] > 50).select("record_id")


@query("pred_subnet_v6", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 16 < 8")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/supplier.parquet").withColumn("ip", F.concat(F.lit("FE80::1:"), F.lower(F.hex(F.col("s_suppkey") % 16)), F.lit(":0")))
    return p.where(rows, p.compare("ip", "InSubnet", "fe80::1:0:0/109")).select("s_suppkey")


@query("pred_guaranteed", _EVENTS + "SELECT 1 AS n, '1001,1002' AS ids, count(*) AS rows FROM c WHERE event_id IN (1001, 1002) UNION ALL SELECT 2, '1001', count(*) FROM c WHERE event_id = 1001 UNION ALL SELECT 3, NULL, count(*) FROM c")
def _(spark, d):
    """Which event ids predicates allow at most, and the rows that a scan by these ids reads."""
    id_, rows = p.Field("event_id"), events(spark, d)
    shown = [p.guaranteed(x, "event_id") for x in (id_.in_(1001, 1002), (id_ == 1001) & (p.Field("k") > 3), (id_ == 1001) | (p.Field("k") > 3))]
    read = [F.count_if(F.col("event_id").isin(sorted(s)) if s is not None else F.lit(True)) for s in shown]
    out = [F.struct(F.lit(i + 1).alias("n"), F.lit(None if s is None else ",".join(map(str, sorted(s)))).cast("string").alias("ids"), n.alias("rows")) for i, (s, n) in enumerate(zip(shown, read))]
    return rows.agg(F.array(*out).alias("a")).select(F.inline("a"))


@query("pred_xpath", "SELECT event_id AS record_id FROM events WHERE event_type = 'error' AND value > 50")
def _(spark, d):
    made = F.concat(F.lit('<Event xmlns="u"><System><Type>'), F.col("type"), F.lit("</Type></System><Value>"), F.col("value").cast("string"), F.lit("</Value></Event>"))
    return events(spark, d).select("record_id", made.alias("xml")).where(files.matches_xpath("xml", "/Event[System/Type='error' and Value > 50]")).select("record_id")


# Views, privacy and values

_SIMPLE = [v for v in views.LEAVES if v[0] not in views.UNAVAILABLE]


def _leaf_sample(spark: SparkSession) -> DataFrame:
    """A row for each selector of every leaf view: log, id, provider, and payloads that their conditions ask for."""
    rows = []
    for name, log, ids, providers in _SIMPLE:
        values = {"LmPackageName": "NTLM V1", "AttributeLDAPDisplayName": "gPLink" if name == "ADGroupPolicyLinks" else "versionNumber", "CorruptionActionState": "1", "ServiceName": "npcap", "SubjectUserName": "bob"}
        kind = {"ADComputerChangeDetailed": "computer", "ADUserChangeDetailed": "user", "ADGroupChangeDetailed": "group", "ADOrganizationalUnitChangeDetailed": "organizationalUnit", "ADOtherChangeDetailed": "contact", "ADGroupPolicyLinks": "domainDNS"}
        values["ObjectClass"] = kind.get(name, "groupPolicyContainer")
        for i in ids:
            for provider in providers or ("any",):
                rows.append((name, log.upper(), i, provider.lower(), values))
    return canonical(spark.createDataFrame(rows, "message string, source_log string, event_id int, provider string, values map<string,string>"))


_SELECTORS = [(name, log, i, provider) for name, log, ids, providers in _SIMPLE for i in ids for provider in providers or ("any",)]


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


def _leaf_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each event as a row of one of the selectors of all leaf views, by its id."""
    kinds = _leaf_sample(spark)
    numbered = spark.createDataFrame([(j, *s) for j, s in enumerate(_SELECTORS)], "_j long, message string, log string, event_id int, provider string")
    kinds = kinds.drop("record_id").join(numbered.select("_j", "message", "event_id", F.lower("provider").alias("provider")), ["message", "event_id", "provider"])
    own = events(spark, d).select("record_id", (F.col("record_id") % len(_SELECTORS)).alias("_j"))
    return canonical(own.join(F.broadcast(kinds), "_j"))  # a row a selector


def _leaf_hits(rows: DataFrame) -> DataFrame:
    hits = F.array_compact(F.array(*[F.when((F.col("message") == n) & views.VIEWS[n].column(), F.lit(n)) for n, *_ in _SIMPLE]))
    return rows.select("record_id", F.explode(hits).alias("view"))


@query("view_leaves", f"SELECT view, count(*) AS rows FROM events JOIN {_values((j, s[0]) for j, s in enumerate(_SELECTORS))} v(j, view) ON event_id % {len(_SELECTORS)} = j GROUP BY 1")
def _(spark, d):
    """Every leaf view takes the rows made for it, whatever the case of log and provider."""
    return _leaf_hits(_leaf_rows(spark, d)).groupBy("view").agg(F.count(F.lit(1)).alias("rows"))


_MEMBERS = [(n, leaf) for n in views.COMPOSITES for leaf in views.expand([n]) if leaf not in views.UNAVAILABLE]


@query("view_composites", f"SELECT c.view, count(*) AS rows FROM events JOIN {_values((j, s[0]) for j, s in enumerate(_SELECTORS))} v(j, leaf) ON event_id % {len(_SELECTORS)} = j JOIN {_values(_MEMBERS)} c(view, leaf) ON c.leaf = v.leaf GROUP BY 1")
def _(spark, d):
    """A composite has the rows of its leaves."""
    members = F.broadcast(spark.createDataFrame(_MEMBERS, "composite string, view string"))
    return _leaf_hits(_leaf_rows(spark, d)).join(members, "view").groupBy(F.col("composite").alias("view")).agg(F.count(F.lit(1)).alias("rows"))


_COLUMNS = [(view, column, kind, keys) for view, own in views.OWN_COLUMNS.items() for column, kind, keys in own]


@query("view_own_columns", f"SELECT view, column_name, count(*) AS rows, count(DISTINCT CASE WHEN kind IN ('text', 'long') THEN event_id WHEN kind = 'time' THEN event_id % 28 ELSE event_id % 2 END) AS values FROM events JOIN {_values((j, v, c, k) for j, (v, c, k, _) in enumerate(_COLUMNS))} x(j, view, column_name, kind) ON event_id % {len(_COLUMNS)} = j GROUP BY 1, 2")
def _(spark, d):
    """The columns that views have of their own: each event brings one of them, under one of the keys that it may have."""
    n, j = F.col("record_id"), (F.col("record_id") % len(_COLUMNS)).cast("int")
    table = spark.createDataFrame([(i, v, c, k, list(keys)) for i, (v, c, k, keys) in enumerate(_COLUMNS)], "j int, view string, column_name string, kind string, keys array<string>")
    rows = events(spark, d).select("record_id", j.alias("j")).join(F.broadcast(table), "j")
    said = F.when(F.col("kind") == "time", F.concat(F.lit("2024-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit(" 00:00:00"))).when(F.col("kind") == "truth", F.when(n % 2 == 0, "true").otherwise("false")).otherwise(n.cast("string"))
    key = F.get("keys", (F.floor(n / len(_COLUMNS)) % F.size("keys")).cast("int"))
    rows = rows.withColumn("values", F.create_map(key, said))
    shown = {v: views.own_columns(v) for v in views.OWN_COLUMNS}
    got = F.coalesce(*[F.when(F.col("j") == i, shown[v][c].cast("string")) for i, (v, c, _, _) in enumerate(_COLUMNS)])
    return rows.groupBy("view", "column_name").agg(F.count(got).alias("rows"), F.count_distinct(got).alias("values"))


@query("view_sources", f"SELECT log, id AS event_id, provider, count(*) AS rows FROM events JOIN {_values((j, log, i, pr) for j, (_, log, i, pr) in enumerate(_SELECTORS))} v(j, log, id, provider) ON event_id % {len(_SELECTORS)} = j WHERE (log, id, provider) IN (('Security', 1104, 'Microsoft-Windows-Eventlog'), ('System', 104, 'Microsoft-Windows-Eventlog')) GROUP BY ALL")
def _(spark, d):
    """What two views need to read, as a filter of rows by log, id and provider."""
    found = views.sources(["LogsClearedOther", "LogsFullSecurity"])
    needs = spark.createDataFrame([(log, i, pr) for log, (ids, providers) in found.items() for i in ids for pr in providers], "log string, event_id int, need string")
    rows = _leaf_rows(spark, d)
    met = rows.join(F.broadcast(needs), (F.upper("log") == F.upper("source_log")) & (rows["event_id"] == needs["event_id"]) & (F.lower("need") == F.lower("provider")))
    return met.groupBy("log", needs["event_id"], F.col("need").alias("provider")).agg(F.count(F.lit(1)).alias("rows"))


@query("view_preset", "SELECT event_id AS record_id FROM events WHERE event_type = 'click' AND event_id % 5 = 0")
def _(spark, d):
    return views.preset(windows_log(spark, d), "AuthenticationHealth").select("record_id")


@query("view_own", "SELECT event_id AS record_id FROM events WHERE event_type = 'error' AND event_id % 3 <> 0")
def _(spark, d):
    """A view of one's own with a condition on the payload, beside the built-in ones."""
    own = views.View("OwnFailures", "Security", (4625,), ())
    rows = windows_log(spark, d)
    return rows.where(own.column() & (payload("IpAddress") != "-")).select("record_id")


_KEY = b"0123456789abcdef0123456789abcdef"


@query("privacy_projection", "SELECT event_id AS record_id, 2 AS keys, event_id % 4 || '' AS logon_type, length('user' || user_id) > 0 AS known FROM events")
def _(spark, d):
    rows = privacy.project(windows_log(spark, d), ["LogonType"], ["TargetUserName"], _KEY)
    return rows.select("record_id", F.size("values").alias("keys"), payload("LogonType").alias("logon_type"), payload("TargetUserName").startswith("hmac-sha256:").alias("known"))


def _token(name: str) -> str:
    return "hmac-sha256:" + hmac.new(_KEY, b"c_mktsegment\0text\0" + name.encode(), hashlib.sha256).hexdigest()


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("privacy_tokens", "SELECT t.token, count(*) AS customers FROM customer c JOIN (VALUES " + ", ".join(f"('{s}', '{_token(s)}')" for s in _SEGMENTS) + ") t(name, token) ON c.c_mktsegment = t.name GROUP BY 1")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet").withColumn("token", privacy.token("c_mktsegment", F.col("c_mktsegment"), _KEY))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("customers"))


@query("enrich_names", "SELECT event_id, 'host-' || user_id % 16 AS host_name FROM events")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").withColumn("ip", F.concat(F.lit("10.0.0."), F.col("user_id") % 16))
    return enrich.resolve_names(rows, "ip", lookup=lambda a: "host-" + a.rpartition(".")[2]).select("event_id", "host_name")


@query("enrich_triage", "SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'not joined' ELSE '' END AS failed, c_name AS tenant FROM customer")
def _(spark, d):
    said = F.concat(F.lit("AzureAdJoined : "), F.when(F.col("c_nationkey") % 2 == 0, "NO").otherwise("YES"), F.lit("\r\n   TenantName : "), F.col("c_name"))
    out = enrich.triage(spark.read.parquet(f"{d}/customer.parquet").withColumn("said", said), "said", {"not joined": p.compare("AzureAdJoined", "Equal", "no"), "no tenant": p.compare("TenantName", "IsNull")})
    return out.select("c_custkey", F.array_join("failed_checks", ",").alias("failed"), F.col("fields")["TenantName"].alias("tenant"))


@query("fn_text", r"""SELECT c_custkey, c_name || '\' || c_mktsegment AS joined, c_mktsegment || '\' || c_name AS swapped, c_name AS alone, substr(c_name, 1, 9) || '…' AS cut, 'Subject User Name' AS words, '10.0.0.' || c_custkey % 256 AS ip,
'CN=' || c_custkey || ',DC=x' AS dn, '' AS blank, c_name AS subject, 'line ' || c_custkey AS line, c_name || c_mktsegment AS longest, sha256(c_name) AS hash FROM customer""")
def _(spark, d):
    name, segment, key = F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey").cast("string")
    message = F.concat(name, F.lit("\r\n\r\nline "), key)
    return spark.read.parquet(f"{d}/customer.parquet").select(
        "c_custkey", text.joined_values(name, segment).alias("joined"), text.joined_values(name, segment, swapped=True).alias("swapped"), text.joined_values(F.lit(None).cast("string"), name).alias("alone"), text.truncate(name, 10).alias("cut"),
        text.split_words(F.lit("SubjectUserName")).alias("words"), text.normalize_ip(F.concat(F.lit("::FFFF:10.0.0."), (F.col("c_custkey") % 256).cast("string"))).alias("ip"), decode.distinguished_name(F.concat(F.lit("CN = "), key, F.lit(" ; DC=x"))).alias("dn"),
        text.blank_to_empty(F.lit(" - ")).alias("blank"), text.message_subject(message).alias("subject"), text.message_line(message, 2).alias("line"), text.longest(name, F.concat(name, segment), F.lit(None).cast("string"), segment).alias("longest"), F.sha2(name, 256).alias("hash"),
    )


@query("fn_snake_keys", "SELECT event_id AS record_id, 'user' || user_id AS target_user_name, CASE WHEN event_id % 3 = 0 THEN '-' ELSE '10.0.0.1' END AS ip_address FROM events")
def _(spark, d):
    keys = text.snake_keys(F.col("values"))
    return windows_log(spark, d).select("record_id", keys["target_user_name"].alias("target_user_name"), keys["ip_address"].alias("ip_address"))


@query("fn_times", "SELECT o_orderkey, o_orderdate AS utc, date_trunc('minute', o_orderdate) AS loose, CAST(NULL AS TIMESTAMP) AS none FROM orders")
def _(spark, d):
    when = F.col("o_orderdate")
    return spark.read.parquet(f"{d}/orders.parquet").select(
        "o_orderkey", times.parse_utc(F.concat(F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).alias("utc"), times.parse_loose(F.concat(F.lit("‎"), F.date_format(when, "M/d/yyyy H:mm"))).alias("loose"), times.parse_loose(F.lit("soon")).alias("none"),
    )


@query("fn_codes", """SELECT p_partkey, p_size AS decimal, p_size AS hexadecimal, p_size & 8 <> 0 AS aes, p_size & 4 <> 0 AS rc4, p_size IN (1, 3, 23, 24) AS weak, CASE p_size % 3 WHEN 0 THEN 'Act as part of the operating system' ELSE 'SeOther' END AS privilege,
CASE p_size % 2 WHEN 0 THEN 'Logitech' END AS vendor, CASE p_size % 2 WHEN 0 THEN 'Yes' ELSE 'No' END AS answer, CASE p_size % 2 WHEN 0 THEN 'Tpm' ELSE 'ExternalKey' END AS protector FROM part""")
def _(spark, d):
    size, even = F.col("p_size"), F.col("p_size") % 2 == 0
    return spark.read.parquet(f"{d}/part.parquet").select(
        "p_partkey", decode.integer(F.concat(F.lit(" +"), size)).cast("int").alias("decimal"), decode.integer(F.concat(F.lit("0X"), F.hex(size))).cast("int").alias("hexadecimal"), (decode.supports_aes(size.bitwiseAND(8))).alias("aes"), decode.supports_rc4(size).alias("rc4"),
        decode.weak_encryption(size).alias("weak"), decode.privilege(F.when(size % 3 == 0, "SeTcbPrivilege").otherwise("SeOther")).alias("privilege"), decode.vendor(F.when(even, r"USB\VID_046D&PID_1").otherwise("x")).alias("vendor"),
        decode.resource(F.when(even, " %%1842").otherwise("%%1843"), decode.YES_NO).alias("answer"), decode.name_of(F.when(even, 2200).otherwise(2201), decode.PROTECTORS).alias("protector"),
    )


@query("fn_flags_all", "SELECT c_custkey, list_transform(list_filter([{'b': 1, 'n': 'SCRIPT'}, {'b': 2, 'n': 'ACCOUNTDISABLE'}, {'b': 8, 'n': 'HOMEDIR_REQUIRED'}, {'b': 16, 'n': 'LOCKOUT'}, {'b': 32, 'n': 'PASSWD_NOTREQD'}, {'b': 64, 'n': 'PASSWD_CANT_CHANGE'}, {'b': 128, 'n': 'ENCRYPTED_TEXT_PWD_ALLOWED'}, {'b': 256, 'n': 'TEMP_DUPLICATE_ACCOUNT'}, {'b': 512, 'n': 'NORMAL_ACCOUNT'}, {'b': 4, 'n': 'UNKNOWN_0x4'}], lambda x: (c_custkey % 1024) & x.b <> 0), lambda x: x.n) AS flags FROM customer")
def _(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", decode.flags(F.col("c_custkey") % 1024).alias("flags"))


@query("fn_multi_value_all", "SELECT p_partkey, list_sort(list_distinct([upper(p_brand), upper(p_type)])) AS parts FROM part")
def _(spark, d):
    joined = F.concat_ws(" ;\n", "p_type", "p_brand", F.lower("p_brand"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.transform(text.distinct_values(joined), F.upper).alias("parts"))


@query("fn_policy_options", "SELECT s_suppkey, s_suppkey % 4 AS options, s_suppkey % 4 & 1 = 0 AS enabled, s_suppkey % 4 & 2 <> 0 AS enforced FROM supplier")
def _(spark, d):
    link = F.concat(F.lit("[LDAP://cn={"), "s_suppkey", F.lit("},dc=x;"), F.col("s_suppkey") % 4, F.lit("]"))
    return spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", F.inline(decode.policy_links(link))).select("s_suppkey", "options", "enabled", "enforced")


@query("fn_kinds_by_row", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'SecurityIdentifier' WHEN 1 THEN 'DistinguishedName' WHEN 2 THEN 'ResourceIdentifier' ELSE 'MultiValue' END AS kind FROM customer")
def _(spark, d):
    key = F.col("c_custkey").cast("string")
    shown = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("S-1-5-21-"), key)).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("CN="), key, F.lit(",DC=x"))).when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("%%"), key)).otherwise(F.concat(key, F.lit(";x")))
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", decode.kind_of(shown).alias("kind"))


@query("src_observation_rows", "SELECT event_id AS record_id, CAST(user_id AS VARCHAR) AS source_computer, 'collector' AS collector_computer, 1::BIGINT AS same FROM events")
def _(spark, d):
    """Each row's fields, and how many rows share its identity."""
    from chronolith.schema import observed

    rows = observed(events(spark, d))
    shared = rows.groupBy("observation_identity").agg(F.count(F.lit(1)).alias("same"))
    return rows.join(shared, "observation_identity").select("record_id", F.col("fields")["SourceComputer"].alias("source_computer"), F.col("fields")["CollectorComputer"].alias("collector_computer"), "same")


# Files

def _xml_text(spark: SparkSession, d: str) -> DataFrame:
    tag = lambda n, v: F.concat(F.lit(f"<{n}>"), v, F.lit(f"</{n}>"))
    return events(spark, d).select(F.concat(
        F.lit('<Event><System><Provider Name="app"/>'), tag("EventID", F.col("event_id").cast("string")), F.lit("<Level>4</Level>"), F.lit('<TimeCreated SystemTime="'), F.date_format("time_created", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit('"/>'),
        tag("EventRecordID", F.col("record_id").cast("string")), F.lit("<Channel>Application</Channel>"), tag("Computer", F.col("source_computer")), F.lit('</System><EventData><Data Name="k">'), F.coalesce(F.col("k"), F.lit("")), F.lit("</Data></EventData></Event>"),
    ).alias("value"))


@query("src_xml_files", _EVENTS + "SELECT record_id, event_id, source_computer, time_created, k FROM c")
def _(spark, d):
    path = _folder(spark, "xml")
    files.write_documents(_xml_text(spark, d), path, "Events")
    return files.read_xml(spark, path).select("record_id", "event_id", "source_computer", "time_created", F.element_at("values", "k").alias("k"))


@query("src_json_lines", _EVENTS + "SELECT record_id, type, time_created, k FROM c")
def _(spark, d):
    path = _folder(spark, "jsonl")
    files.export(events(spark, d), path, "jsonl")
    return files.read_json_lines(spark, path).select("record_id", "type", "time_created", payload("k").alias("k"))


@query("sink_csv", _EVENTS + "SELECT CAST(record_id AS VARCHAR) AS record_id, type, k, value FROM c")
def _(spark, d):
    path = _folder(spark, "csv")
    files.export(events(spark, d), path, "csv")
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return back.select("record_id", "type", F.get_json_object("values_json", "$.k").alias("k"), F.get_json_object("values_json", "$.value").cast("double").alias("value"))


@query("sink_xml", _EVENTS + "SELECT record_id, type FROM c")
def _(spark, d):
    path = _folder(spark, "xml-out")
    files.export(events(spark, d), path, "xml")
    return spark.read.format("xml").option("rowTag", "Event").schema("record_id long, type string").load(path)


@query("sink_report", "SELECT event_type AS section, count(*) AS rows FROM events WHERE event_type IN ('error', 'view') GROUP BY 1")
def _(spark, d):
    manifest = files.report_files(scan.sections(events(spark, d), ["error", "view"]), _folder(spark, "report"))
    return spark.createDataFrame(sorted(manifest.items()), "section string, rows long")


@query("sink_manifest", "SELECT 'whole' AS export, 0::BIGINT AS wrong UNION ALL SELECT 'changed', 2")
def _(spark, d):
    """An export against its own manifest, and against one with its first file renamed."""
    path = _folder(spark, "manifest")
    files.export(events(spark, d), path, "csv")
    known = written(files.export_manifest(spark, path), "manifest-known")
    first = known.agg(F.min("file").alias("_first"))
    renamed = known.crossJoin(F.broadcast(first)).withColumn("file", F.when(F.col("file") == F.col("_first"), F.concat("file", F.lit("x"))).otherwise(F.col("file"))).drop("_first")
    sides = (("whole", known), ("changed", renamed))
    parts = [files.changed_files(spark, path, k).agg(F.lit(n).alias("export"), F.count(F.lit(1)).alias("wrong")) for n, k in sides]
    return parts[0].unionByName(parts[1])


@query("src_framed_log", "SELECT o_orderkey, o_orderdate + INTERVAL 60 MINUTE AS time, 'Orders' AS component FROM orders")
def _(spark, d):
    path = _folder(spark, "framed")
    o = spark.read.parquet(f"{d}/orders.parquet")
    line = F.concat(F.lit("<![LOG[order "), F.col("o_orderkey"), F.lit('\nplaced]LOG]!><time="'), F.date_format("o_orderdate", "HH:mm:ss"), F.lit('.000+060" date="'), F.date_format("o_orderdate", "MM-dd-yyyy"), F.lit('" component="Orders" context="" type="1" thread="7" file="f">'))
    o.select(line.alias("value")).write.text(path)
    return files.read_framed_log(spark, path).select(F.regexp_extract("text", r"order (\d+)", 1).cast("long").alias("o_orderkey"), "time", "component")


@query("src_plain_log", "SELECT event_id AS record_id, date_trunc('second', ts) AS time, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level FROM events WHERE date_trunc('second', ts) > TIMESTAMP '2024-01-10 00:00:00'")
def _(spark, d):
    path = _folder(spark, "plain")
    line = F.concat(F.date_format("time_created", "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), F.when(F.col("type") == "error", "Error").otherwise("info"), F.lit("] event "), F.col("record_id"))
    events(spark, d).select(F.explode(F.array(line, F.lit("   a line of the record before"))).alias("value")).write.text(path)
    return files.read_plain_log(spark, path, after="2024-01-10 00:00:00").select(F.regexp_extract("text", r"event (\d+)", 1).cast("long").alias("record_id"), "time", "level")


@query("src_script_context", "SELECT c_custkey, c_name AS host, c_mktsegment AS user FROM customer")
def _(spark, d):
    made = files.script_context(F.concat(F.lit("   Host Name = "), F.col("c_name"), F.lit("\r\nno pair\r\n        User=  "), F.col("c_mktsegment"), F.lit("\r\n")))
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", made["Host Name"].alias("host"), made["User"].alias("user"))


# The store

def _stored(spark: SparkSession, d: str, name: str) -> store.Store:
    made = store.Store(spark, _folder(spark, name))
    made.write(identified(spark, d))
    return made


@query("store_prune", "SELECT event_id AS record_id FROM events WHERE NOT (ts < TIMESTAMP '2024-01-15 12:00:00' AND event_type IN ('view', 'click'))")
def _(spark, d):
    made = _stored(spark, d, "prune")
    made.prune(datetime(2024, 1, 15, 12), ["View", "CLICK"])
    return made.read().select("record_id")


@query("store_backup", "SELECT event_type AS type, count(*) AS count, true AS verified FROM events GROUP BY 1")
def _(spark, d):
    made, target = _stored(spark, d, "backup"), _folder(spark, "restored")
    made.move_checkpoint("c", None, "1")
    known = made.backup(target)
    copy = store.Store(spark, target)
    return copy.read().groupBy("type").agg(F.count(F.lit(1)).alias("count")).withColumn("verified", F.lit(copy.verify(known) and copy.checkpoint("c") == "1"))


@query("store_findings", "SELECT 'bad' AS rule_id, CAST(event_id AS VARCHAR) AS evidence FROM events WHERE event_type = 'error' AND value > 50")
def _(spark, d):
    made = _stored(spark, d, "findings")
    found = made.detect([rules.Rule("bad", selector=rules.Selector(types=("error",), predicate=p.Field("value") > 50))])
    made.write_findings(found)
    made.write_findings(found)
    return made.findings().select("rule_id", F.array_join("evidence", ",").alias("evidence"))


@query("store_findings_of", "SELECT 'bad' AS rule_id, min(event_id) AS record_id FROM events WHERE event_type = 'error'")
def _(spark, d):
    made = _stored(spark, d, "findings-of")
    made.write_findings(made.detect([rules.Rule("bad", selector=rules.Selector(types=("error",)))]))
    first = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'error'").agg(F.min("event_id")).first()[0]
    return made.findings(str(first)).select("rule_id", F.get("evidence", F.lit(0)).cast("long").alias("record_id"))


@query("store_ordered", "SELECT event_id AS record_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-05' ORDER BY ts DESC, event_id DESC LIMIT 100")
def _(spark, d):
    return _stored(spark, d, "ordered").newest(100, p.Field("type") == "ERROR", start=datetime(2024, 1, 5)).select("record_id")


@query("store_checkpoints", "SELECT step, moved, (SELECT max(event_id) FROM events WHERE event_type = 'click') AS position FROM (VALUES ('first', true), ('again', false), ('next', true)) v(step, moved)")
def _(spark, d):
    """A checkpoint moves to a table's positions, from where it is only; it ends at the last click."""
    made = store.Store(spark, _folder(spark, "checkpoints"))
    tops = {r["type"]: str(r["top"]) for r in events(spark, d).groupBy("type").agg(F.max("record_id").alias("top")).collect()}  # five types
    moves = [("first", None, "error"), ("again", None, "view"), ("next", "error", "click")]
    done = [(step, made.move_checkpoint("c", tops.get(was), tops[to])) for step, was, to in moves]
    return spark.createDataFrame([(*x, int(made.checkpoint("c"))) for x in done], "step string, moved boolean, position long")


# Streams

def _streamed(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return from_app_events(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)).withColumn("observation_identity", F.col("record_id").cast("string"))


def _table(spark: SparkSession, rows: DataFrame, mode: str = "append") -> DataFrame:
    """The result of a stream that ends with its input, written by tasks; state lies in RocksDB, since it grows with the keys."""
    key = "spark.sql.streaming.stateStore.providerClass"
    was, out = spark.conf.get(key), _folder(spark, "streamed")
    ordered.use_rocksdb(spark)
    try:
        sink = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/at").trigger(availableNow=True)
        if mode == "append":
            sink.format("parquet").option("path", f"{out}/rows").start().awaitTermination()
        else:  # each batch has the whole result
            sink.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{out}/rows")).start().awaitTermination()
    finally:
        spark.conf.set(key, was)
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")


@query("stream_threshold", _THRESHOLD + _FOUND.format(rule="errors"))
def _(spark, d):
    rule = rules.Rule("errors", kind="Threshold", selector=rules.Selector(types=("error",)), threshold=3, window_seconds=432000, group_by="source_computer")
    found = _table(spark, streams.rule_findings(_streamed(spark, d), rule))
    return found.select("rule_id", "group_value", F.lit("Matched").alias("status"), F.timestamp_micros("event_us").alias("event_time"), F.array_join("evidence", ",").alias("evidence"))


@query("stream_ordered", _ordered_sql())
def _(spark, d):
    rule = rules.Rule("order", kind="OrderedTemporal", steps=_steps(*_STEP_TYPES), window_seconds=259200, group_by="source_computer")
    found = _table(spark, streams.rule_findings(_streamed(spark, d), rule))
    return found.select("rule_id", "group_value", F.lit("Matched").alias("status"), F.timestamp_micros("event_us").alias("event_time"), F.array_join("evidence", ",").alias("evidence"))


@query("stream_delivered_once", "SELECT event_id AS record_id FROM events")
def _(spark, d):
    rows = _streamed(spark, d).select("record_id", "time_created", "observation_identity")
    return _table(spark, streams.delivered_once(rows.union(rows))).select("record_id")


@query("stream_windowed_counts", "SELECT date_trunc('hour', ts) AS bucket, event_type AS type, count(*) AS count FROM events GROUP BY 1, 2")
def _(spark, d):
    return _table(spark, streams.windowed_counts(_streamed(spark, d)), "complete")


@query("stream_ingest", "SELECT event_type AS type, count(*) AS count FROM events GROUP BY 1")
def _(spark, d):
    made, at = store.Store(spark, _folder(spark, "ingest")), _folder(spark, "ingest-at")
    streams.ingest(_streamed(spark, d), made, at, availableNow=True).awaitTermination()
    return made.read().groupBy("type").agg(F.count(F.lit(1)).alias("count"))


@query("stream_replay", _THRESHOLD + "SELECT CAST(user_id AS VARCHAR) AS group_value, array_to_string(evidence, ',') AS evidence FROM s WHERE len(evidence) > 0")
def _(spark, d):
    made, at = store.Store(spark, _folder(spark, "replay")), _folder(spark, "replay-at")
    rule = rules.Rule("errors", kind="Threshold", selector=rules.Selector(types=("error",)), threshold=3, window_seconds=432000, group_by="source_computer")
    streams.replay(_streamed(spark, d), rule, made, "r", at, availableNow=True).awaitTermination()
    return made.findings().select("group_value", F.array_join("evidence", ",").alias("evidence"))


@query("stream_outbox", "SELECT event_id AS record_id, 'no way' AS error FROM events")
def _(spark, d):
    """A sink that always fails: what it was given lies among the dead letters."""
    path, at = _folder(spark, "dead"), _folder(spark, "dead-at")

    def refuse(df: DataFrame, batch: int) -> None:
        raise ValueError("no way")

    streams.outbox(_streamed(spark, d).select("record_id"), refuse, path, at, attempts=2, availableNow=True).awaitTermination()
    return spark.read.parquet(path).select("record_id", "error")


@query("stream_lacking", "SELECT 'lack' AS rule_id, 'Incomplete' AS status, 'nothing' AS field, 1 AS findings")
def _(spark, d):
    """Rows of a stream without the rule's group field give one Incomplete finding, not silence."""
    rule = rules.Rule("lack", kind="Threshold", selector=rules.Selector(types=("error",)), threshold=2, window_seconds=60, group_by="nothing")
    found = _table(spark, streams.lacking(_streamed(spark, d), rule))
    return found.groupBy("rule_id", "status", "field").agg(F.count(F.lit(1)).cast("int").alias("findings"))


@query("stream_late", "SELECT count(*) FILTER (ts < TIMESTAMP '2024-01-20') AS late, count(*) FILTER (ts >= TIMESTAMP '2024-01-20') AS in_time FROM events")
def _(spark, d):
    """Rows behind a fixed watermark are told apart, none is lost."""
    made = streams.split_late(events(spark, d), datetime(2024, 1, 20))
    return made.agg(F.count_if("late").alias("late"), F.count_if(~F.col("late")).alias("in_time"))
