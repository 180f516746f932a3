"""Registered queries and their DuckDB oracles, one pair a line of work."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions import decode, normalize, text, times
from chronolith.operators import aggregate as agg
from chronolith.scratch import folder as _folder
from chronolith.operators import context, detect, occurrences, policy, reports, rules, scan, timeline, views
from chronolith.operators import predicates as p
from chronolith.schema import canonical, from_app_events, observed, payload
from chronolith.sources import files, store
from chronolith.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The canonical application events in SQL.
_EVENTS = """WITH c AS (
  SELECT ts AS time_created, event_type AS type, CASE event_type WHEN 'click' THEN 1001 WHEN 'error' THEN 1002 WHEN 'purchase' THEN 1003 WHEN 'signup' THEN 1004 WHEN 'view' THEN 1005 END AS event_id,
         event_id AS record_id, CAST(user_id AS VARCHAR) AS source_computer, value, json_extract_string(props, '$.k') AS k FROM events
)
"""


def query(name: str, oracle: str | None = None):
    def kept(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return kept


def events(spark: SparkSession, d: str) -> DataFrame:
    return from_app_events(spark.read.parquet(f"{d}/events.parquet"))


def identified(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).withColumn("observation_identity", F.col("record_id").cast("string"))


_FLAG = agg.Definition(
    group_by=("type",),
    measures=(agg.Measure("Count", "count"), agg.Measure("DistinctCount", "users", "source_computer"), agg.Measure("FirstSeen", "first_seen", "time_created"), agg.Measure("LastSeen", "last_seen", "time_created"), agg.Measure("Rate", "per_hour")),
    bucket="Day", top=2, scope="bucket",
)


@query("agg_daily_top", _EVENTS + """, g AS (
  SELECT date_trunc('day', time_created) AS bucket_start, type, count(*) AS count, count(DISTINCT source_computer) AS users, min(time_created) AS first_seen, max(time_created) AS last_seen FROM c
  WHERE type IN ('click', 'view', 'purchase', 'error') AND value > 10 GROUP BY 1, 2
), r AS (SELECT *, row_number() OVER (PARTITION BY bucket_start ORDER BY count DESC, concat('4:Text', length(type), ':', upper(type), '|')) AS n FROM g)
SELECT bucket_start, bucket_start + INTERVAL 1 DAY AS bucket_end, type, count, users, first_seen, last_seen, count / 24.0::DOUBLE AS per_hour FROM r WHERE n <= 2""")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d)
    some = p.Field("type").in_("click", "view", "purchase", "error") & (p.Field("value") > 10)
    return agg.aggregate(p.where(rows, some), _FLAG)


@query("agg_hour_rate", _EVENTS + """SELECT date_trunc('hour', time_created) AS bucket_start, date_trunc('hour', time_created) + INTERVAL 1 HOUR AS bucket_end, type, count(*) / 60.0::DOUBLE AS per_minute FROM c GROUP BY 1, 2, 3""")
def _(spark, d):
    return agg.aggregate(events(spark, d), agg.Definition(("type",), (agg.Measure("Rate", "per_minute", unit_seconds=60),), bucket="Hour", rank_by="per_minute"))


@query("agg_week_global_top", _EVENTS + """, t AS (SELECT source_computer FROM c GROUP BY 1 ORDER BY count(*) DESC, concat('4:Text', length(source_computer), ':', source_computer, '|') LIMIT 3)
SELECT date_trunc('week', time_created) AS bucket_start, date_trunc('week', time_created) + INTERVAL 7 DAY AS bucket_end, source_computer, count(*) AS count FROM c WHERE source_computer IN (SELECT source_computer FROM t) GROUP BY 1, 2, 3""")
def _(spark, d):
    return agg.aggregate(events(spark, d), agg.Definition(("source_computer",), bucket="Week", top=3, scope="global"))


@query("agg_month", """SELECT date_trunc('month', o_orderdate) AS bucket_start, date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS bucket_end, o_orderpriority, count(*) AS count, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1, 2, 3""")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").withColumnRenamed("o_orderdate", "time_created")
    return agg.aggregate(rows, agg.Definition(("o_orderpriority",), (agg.Measure("Count", "count"), agg.Measure("DistinctCount", "customers", "o_custkey")), bucket="Month"))


@query("agg_top_rows", """SELECT l_suppkey, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY count DESC, concat('6:Number', length(CAST(l_suppkey AS VARCHAR)), ':', l_suppkey, '|') LIMIT 10""")
def _(spark, d):
    return agg.aggregate(spark.read.parquet(f"{d}/lineitem.parquet"), agg.Definition(("l_suppkey",), top=10))


@query("agg_null_groups", _EVENTS + """SELECT CASE WHEN type = 'error' THEN NULL ELSE upper(type) END AS kind, count(*) AS count, count(DISTINCT k) + 0 AS ks FROM c WHERE type <> 'error' GROUP BY 1""")
def _(spark, d):
    rows = events(spark, d).withColumn("kind", F.when(F.col("type") != "error", F.upper("type")))
    return agg.aggregate(rows, agg.Definition(("kind",), (agg.Measure("Count", "count"), agg.Measure("DistinctCount", "ks", "k")), include_null_groups=False))


@query("agg_case_display", """SELECT min(x) AS segment, count(*) AS count FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS x FROM customer) GROUP BY upper(x)""")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet").withColumn("segment", F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")))
    return agg.aggregate(rows, agg.Definition(("segment",)))


@query("agg_zone_day", _EVENTS + """SELECT timezone('UTC', timezone('America/New_York', date_trunc('day', timezone('America/New_York', timezone('UTC', time_created))))) AS bucket_start, type, count(*) AS count FROM c GROUP BY 1, 2""")
def _(spark, d):
    return agg.aggregate(events(spark, d), agg.Definition(("type",), bucket="Day", zone="America/New_York")).drop("bucket_end")


@query("agg_complete", """SELECT least((SELECT count(DISTINCT user_id) FROM events), 101) AS groups, least((SELECT count(DISTINCT event_type) FROM events), 100001) AS distinct_values, (SELECT count(DISTINCT user_id) FROM events) <= 100 AS complete""")
def _(spark, d):
    return agg.complete(events(spark, d), agg.Definition(("source_computer",), (agg.Measure("DistinctCount", "types", "type"),)), max_groups=100)


@query("agg_store_summary", _EVENTS + "SELECT date_trunc('day', time_created) AS period, type, count(*) AS count, min(time_created) AS first_seen, max(time_created) AS last_seen FROM c GROUP BY 1, 2")
def _(spark, d):
    return agg.store_summary(events(spark, d))


@query("agg_chart_series", _EVENTS + "SELECT date_trunc('day', time_created) AS bucket_start, sum(CASE WHEN type = 'click' THEN 1 END)::BIGINT AS click, sum(CASE WHEN type = 'view' THEN 1 END)::BIGINT AS view FROM c GROUP BY 1")
def _(spark, d):
    return agg.chart_series(agg.aggregate(events(spark, d), agg.Definition(("type",), bucket="Day")), "bucket_start", "type", "count", ["click", "view"])


def _pick(name: str, predicate: Callable[[], p.Predicate], table: str, keys: str, where: str) -> None:
    def run(spark, d):
        rows = events(spark, d) if table == "c" else spark.read.parquet(f"{d}/{table}.parquet")
        return p.where(rows, predicate()).select(*keys.split(", "))

    query(name, (_EVENTS if table == "c" else "") + f"SELECT {keys} FROM {table} WHERE {where}")(run)


_pick("pred_equal", lambda: p.compare("TYPE", "Equal", "ERROR"), "c", "record_id", "type = 'error'")
_pick("pred_not_equal", lambda: p.compare("o_orderstatus", "NotEqual", "o"), "orders", "o_orderkey", "upper(o_orderstatus) <> 'O'")
_pick("pred_in", lambda: p.compare("c_mktsegment", "In", "building", "MACHINERY"), "customer", "c_custkey", "upper(c_mktsegment) IN ('BUILDING', 'MACHINERY')")
_pick("pred_not_in", lambda: p.compare("p_size", "NotIn", *range(1, 20)), "part", "p_partkey", "p_size NOT IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19)")
_pick("pred_contains", lambda: p.compare("p_type", "Contains", "e"), "part", "p_partkey", "contains(upper(p_type), 'E')")
_pick("pred_starts_with", lambda: p.compare("c_mktsegment", "StartsWith", "b"), "customer", "c_custkey", "starts_with(upper(c_mktsegment), 'B')")
_pick("pred_ends_with", lambda: p.compare("p_brand", "EndsWith", "3"), "part", "p_partkey", "ends_with(p_brand, '3')")
_pick("pred_wildcard", lambda: p.compare("c_name", "MatchesWildcard", "cust*[0-4]?"), "customer", "c_custkey", "regexp_full_match(lower(c_name), 'cust.*[0-4].')")
_pick("pred_regex", lambda: p.compare("p_brand", "MatchesRegex", "#[12]"), "part", "p_partkey", "regexp_matches(p_brand, '#[12]')")
_pick("pred_compare", lambda: p.all_of(p.Field("l_quantity") >= 10, p.Field("l_discount") < 0.05, p.Field("l_shipdate") > datetime(1995, 1, 1)), "lineitem", "l_orderkey, l_linenumber", "l_quantity >= 10 AND l_discount < 0.05 AND l_shipdate > TIMESTAMP '1995-01-01'")
_pick("pred_payload_number", lambda: p.compare("k", "GreaterThan", 50), "c", "record_id", "TRY_CAST(k AS DOUBLE) > 50")
_pick("pred_missing", lambda: p.all_of(p.compare("message", "IsNull"), p.compare("nothing", "NotEqual", "x"), ~p.compare("nothing", "Equal", "x"), p.compare("k", "IsNotNull")), "c", "record_id", "k IS NOT NULL")
_pick("pred_any_all_not", lambda: p.any_of(p.all_of(p.Field("type") == "view", p.Field("value") > 50), ~p.any_of(p.Field("type") == "view", p.Field("type") == "click", p.Field("value") < 90)), "c", "record_id", "type = 'view' AND value > 50 OR NOT (type = 'view' OR type = 'click' OR value < 90)")
_pick("pred_error_is_false", lambda: p.any_of(p.compare("type", "GreaterThan", 5), p.compare("event_id", "Equal", 1001)), "c", "record_id", "false")
_pick("pred_expression", lambda: p.from_expression("type in ('click', 'view') and value > 20 and not source_computer.ends_with('7')"), "c", "record_id", "type IN ('click', 'view') AND value > 20 AND NOT ends_with(source_computer, '7')")
_pick("pred_json", lambda: p.from_json(p.to_json((p.Field("type") == "signup") | (p.Field("time_created") >= datetime(2024, 1, 20)))), "c", "record_id", "type = 'signup' OR time_created >= TIMESTAMP '2024-01-20'")


@query("pred_subnet", "SELECT event_id FROM events WHERE user_id % 256 BETWEEN 64 AND 127 AND user_id // 256 = 0")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").withColumn("ip", F.concat(F.lit("10.1."), F.floor(F.col("user_id") / 256), F.lit("."), F.col("user_id") % 256))
    return p.where(rows, p.compare("ip", "InSubnet", "10.1.0.64/26")).select("event_id")


@query("pred_array_field", "SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'user') > 0 AND count(*) FILTER (role <> 'user') > 0")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return p.where(rows, p.compare("roles", "Contains", "USER") & p.compare("roles", "NotEqual", "user")).select("conv_id")


@query("scan_merged_newest", """WITH s AS (SELECT ts AS time_created, CAST(user_id AS VARCHAR) AS source_computer, event_id AS record_id, 0 AS source_index FROM events WHERE event_type = 'view'
UNION ALL SELECT ts, CAST(user_id AS VARCHAR), event_id, 1 FROM events WHERE event_type <> 'view') SELECT record_id, source_index FROM s ORDER BY time_created DESC, source_computer DESC, record_id DESC LIMIT 250""")
def _(spark, d):
    rows = events(spark, d)
    return scan.merged([rows.where("type = 'view'"), rows.where("type <> 'view'")], limit=250).select("record_id", "source_index")


@query("scan_limit_reached", "SELECT count(*) > 500 AS limit_reached FROM events")
def _(spark, d):
    return scan.limited(events(spark, d), 500)[1]


@query("scan_page", "SELECT event_id AS record_id, ts AS time_created FROM events WHERE ts > TIMESTAMP '2024-01-10' OR ts = TIMESTAMP '2024-01-10' AND event_id > 5 ORDER BY ts, event_id LIMIT 200")
def _(spark, d):
    return scan.page(events(spark, d), 200, (datetime(2024, 1, 10), 5)).select("record_id", "time_created")


@query("scan_resume", "SELECT event_id AS record_id FROM events WHERE event_id > 900")
def _(spark, d):
    return scan.read(scan.after(events(spark, d), record_id=900), "Metadata").select("record_id")


@query("scan_flat_filter", _EVENTS + "SELECT record_id FROM c WHERE event_id IN (1001, 1002, 1003) AND record_id > 10 AND record_id < 9000 AND time_created >= TIMESTAMP '2024-01-03' AND k IN ('1', '2', '3', '4', '5', '6') AND NOT (k = '3') AND event_id <> 1003")
def _(spark, d):
    f = scan.Filter(event_ids=(1001, 1002, 1003), record_between=(10, 9000), providers=("APP",), start=datetime(2024, 1, 3), named_data=(("K", ("1", "2", "3", "4", "5", "6")),), excluded_named_data=(("k", ("3",)),), excluded_ids=(1003,))
    return events(spark, d).where(f.column()).select("record_id")


@query("scan_filter_intersection", _EVENTS + "SELECT record_id FROM c WHERE event_id = 1002 AND record_id > 100 AND record_id < 5000")
def _(spark, d):
    f = scan.intersect(scan.Filter(event_ids=(1001, 1002), record_between=(100, None)), scan.Filter(event_ids=(1002, 1004), record_between=(50, 5000)))
    return events(spark, d).where(f.column()).select("record_id")


@query("scan_structured", _EVENTS + "SELECT record_id FROM c WHERE (type = 'error' OR value > 95) AND NOT (source_computer = '7' OR coalesce(k = '9', false))")
def _(spark, d):
    F_ = p.Field
    return scan.structured(events(spark, d), [F_("type") == "error", F_("value") > 95], [F_("source_computer") == "7", F_("k") == "9"]).select("record_id")


@query("scan_inventory", "SELECT DISTINCT source AS name FROM documents WHERE source LIKE 'src1%'")
def _(spark, d):
    return scan.inventory(spark.read.parquet(f"{d}/documents.parquet"), "source", "SRC1*")


@query("scan_latest", "SELECT 'Application' AS source_log, max(ts) AS latest, count(*) AS events FROM events")
def _(spark, d):
    return scan.latest(events(spark, d))


@query("scan_generic_columns", "SELECT event_id AS record_id, json_extract_string(props, '$.k') AS k FROM events")
def _(spark, d):
    return scan.generic_columns(events(spark, d)).select("record_id", F.col("`values.k`").alias("k"))


@query("scan_missing", "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def _(spark, d):
    nation, supplier = spark.read.parquet(f"{d}/nation.parquet"), spark.read.parquet(f"{d}/supplier.parquet")
    return scan.missing(nation, supplier.withColumnRenamed("s_nationkey", "n_nationkey"), ["n_nationkey"]).select("n_name")


@query("scan_period", "SELECT event_id AS record_id FROM events WHERE ts >= TIMESTAMP '2024-01-14' AND ts < TIMESTAMP '2024-01-15'")
def _(spark, d):
    return events(spark, d).where(times.in_period(F.col("time_created"), "PastDay", datetime(2024, 1, 15, 13, 30))).select("record_id")


@query("occ_transport", "SELECT event_id AS record_id, 2::BIGINT AS copies FROM events")
def _(spark, d):
    rows = events(spark, d).withColumn("collector_computer", F.col("source_computer"))  # kept where it came about: direct
    forwarded = rows.withColumn("container_log", F.lit("ForwardedEvents")).withColumn("collector_computer", F.lit("other"))
    return occurrences.representative(occurrences.transport(forwarded.unionByName(rows))).where("container_log = 'Application'").select("record_id", "copies")


@query("occ_none", "SELECT event_id AS record_id, n FROM events, (VALUES (1), (2)) t(n)")
def _(spark, d):
    rows = identified(spark, d)
    return occurrences.none(rows.unionByName(rows)).select("record_id", F.substring_index("occurrence", "-", -1).cast("int").alias("n"))


@query("occ_reassemble", """WITH f AS (SELECT conv_id, turn + 1 AS n, min(text) AS text FROM conversations WHERE turn >= 0 GROUP BY 1, 2)
SELECT conv_id AS script_block_id, md5(string_agg(coalesce(text, ''), '' ORDER BY n)) AS script_md5, count(*) AS parts, count(*) = max(n) AS complete FROM f GROUP BY 1""")
def _(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    total = c.groupBy("conv_id").agg((F.max("turn") + 1).alias("message_total"))
    parts = c.join(total, "conv_id").select(F.col("conv_id").alias("script_block_id"), (F.col("turn") + 1).alias("message_number"), "message_total", F.coalesce("text", F.lit("")).alias("script_block_text"), F.coalesce("text", F.lit("")).alias("time_created"))
    return occurrences.reassemble(parts).select("script_block_id", F.md5("script").alias("script_md5"), "parts", "complete")


@query("ctx_as_of", "SELECT a.event_id, b.event_id AS view_id, b.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts >= b.ts")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    seen = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return context.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), seen, ["user_id"], "ts", "ts", ["view_id", "view_value"]).select("event_id", "view_id", "view_value")


@query("ctx_resolve", """WITH f AS (SELECT user_id, ts AS t, CASE WHEN event_type <> 'error' THEN 'n' || event_id END AS name, event_type = 'error' AS gone FROM events WHERE event_type IN ('signup', 'error')),
q AS (SELECT event_id AS query_id, user_id, ts FROM events WHERE event_type = 'purchase'),
last AS (SELECT q.query_id, q.user_id, f.t, f.name, f.gone, (SELECT max(t) FROM f g WHERE g.user_id = q.user_id) AS newest FROM q ASOF LEFT JOIN f ON q.user_id = f.user_id AND q.ts >= f.t)
SELECT query_id, CASE WHEN t IS NULL THEN 'Unknown' WHEN gone THEN 'Deleted' WHEN t = newest THEN 'Current' ELSE 'Historical' END AS status,
       CAST(user_id AS VARCHAR) AS canonical_id,
       CASE WHEN t IS NULL THEN NULL WHEN NOT gone THEN name ELSE (SELECT arg_max(h.name, h.t) FROM f h WHERE h.user_id = last.user_id AND h.t <= last.t AND NOT h.gone AND NOT EXISTS (SELECT 1 FROM f x WHERE x.user_id = h.user_id AND x.gone AND x.t > h.t AND x.t < last.t)) END AS name
FROM last""")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    gone = F.col("event_type") == "error"
    facts = e.where("event_type IN ('signup', 'error')").select(F.lit("User").alias("object_kind"), F.col("user_id").cast("string").alias("canonical_id"), F.array().cast("array<string>").alias("aliases"), F.when(~gone, F.concat(F.lit("n"), "event_id")).alias("display_name"), (~gone).alias("display_name_observed"), F.col("ts").alias("effective_at"), gone.alias("is_deleted"), F.lit(None).cast("string").alias("authorization_context"))
    asked = e.where("event_type = 'purchase'").select(F.col("event_id").alias("query_id"), F.lit("User").alias("object_kind"), F.col("user_id").cast("string").alias("canonical_id"), F.lit(None).cast("string").alias("alias"), F.col("ts").alias("at"), F.lit(None).cast("string").alias("authorization_context"))
    return context.resolve(asked, facts)


def _correlated(spark, d):
    rows = events(spark, d).withColumn("values", F.map_concat("values", F.create_map(F.lit("Who"), F.col("type"))))
    return timeline.correlate(rows, ("who", "computer"))


@query("time_groups", _EVENTS + "SELECT type AS who, source_computer, count(*) AS count, min(time_created) AS first_seen, max(time_created) AS last_seen, round(epoch_us(max(time_created) - min(time_created)) / 1e6, 3) AS duration FROM c GROUP BY 1, 2")
def _(spark, d):
    g = timeline.groups(_correlated(spark, d))
    return g.select(F.get("types", F.lit(0)).alias("who"), F.get("computers", F.lit(0)).alias("source_computer"), "count", "first_seen", "last_seen", "duration")


@query("time_sequence", _EVENTS + "SELECT record_id, CAST(row_number() OVER (PARTITION BY type, source_computer ORDER BY time_created, record_id) AS INTEGER) AS sequence FROM c")
def _(spark, d):
    return timeline.sequence(_correlated(spark, d)).select("record_id", "sequence")


@query("time_buckets", _EVENTS + """SELECT make_timestamp(CAST((floor((epoch_us(time_created) + 62135596800000000) / 420000000) * 420000000 - 62135596800000000) AS BIGINT)) AS bucket, count(*) AS count, count(DISTINCT type || '|' || source_computer) AS correlations FROM c GROUP BY 1""")
def _(spark, d):
    return timeline.buckets(_correlated(spark, d), 7)


@query("time_gaps", _EVENTS + "SELECT * FROM (SELECT source_computer, time_created AS gap_start, lead(time_created) OVER (PARTITION BY source_computer ORDER BY time_created) AS gap_end FROM c) WHERE epoch_us(gap_end - gap_start) / 1e6 > 86400")
def _(spark, d):
    return timeline.gaps(events(spark, d), ["source_computer"], 86400)


@query("time_islands", _EVENTS + """, w AS (SELECT source_computer, time_created AS s, time_created + INTERVAL 6 HOUR AS e FROM c),
m AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY source_computer ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM w),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY source_computer ORDER BY s, e) AS island FROM m) SELECT source_computer, min(s) AS start, max(e) AS "end" FROM n GROUP BY source_computer, island""")
def _(spark, d):
    w = events(spark, d).select("source_computer", F.col("time_created").alias("start"), (F.col("time_created") + F.expr("INTERVAL 6 HOUR")).alias("end"))
    return timeline.islands(w, ["source_computer"])


@query("time_covered", _EVENTS + """, w AS (SELECT source_computer, time_created AS s, time_created + INTERVAL 12 HOUR AS e FROM c WHERE type = 'view'),
m AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY source_computer ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM w),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY source_computer ORDER BY s, e) AS island FROM m), i AS (SELECT source_computer, min(s) AS s, max(e) AS e FROM n GROUP BY source_computer, island)
SELECT record_id, EXISTS (SELECT 1 FROM i WHERE i.source_computer = c.source_computer AND i.s <= c.time_created AND i.e >= c.time_created + INTERVAL 3 HOUR) AS covered FROM c WHERE type = 'error'""")
def _(spark, d):
    rows = events(spark, d)
    w = rows.where("type = 'view'").select("source_computer", F.col("time_created").alias("start"), (F.col("time_created") + F.expr("INTERVAL 12 HOUR")).alias("end"))
    wanted = rows.where("type = 'error'").select("source_computer", "record_id", F.col("time_created").alias("want_start"), (F.col("time_created") + F.expr("INTERVAL 3 HOUR")).alias("want_end"))
    return timeline.covered(wanted, w, ["source_computer"]).select("record_id", "covered")


@query("time_clock", """WITH e AS (SELECT user_id, ts AS a, ts + INTERVAL 2 DAY AS b, value FROM events WHERE event_type = 'signup')
SELECT x.event_id AS id, CAST(round(trunc(min(-e.value) * 1000000) / 1000) AS BIGINT) AS earliest, CAST(round(trunc(max(e.value) * 1000000) / 1000) AS BIGINT) AS latest FROM events x LEFT JOIN e ON e.user_id = x.user_id AND x.ts BETWEEN e.a AND e.b WHERE x.event_type = 'view' GROUP BY x.event_id, x.ts""")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = e.where("event_type = 'view'").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("computer"), F.col("ts").alias("time"))
    evidence = e.where("event_type = 'signup'").select(F.col("user_id").cast("string").alias("computer"), F.col("ts").alias("valid_from"), (F.col("ts") + F.expr("INTERVAL 2 DAY")).alias("valid_through"), (-F.col("value")).alias("offset_low"), F.col("value").alias("offset_high"))
    shift = lambda c: F.round((F.unix_micros(c) - F.unix_micros("time")) / 1000).cast("long")
    return timeline.clock_bounds(rows, evidence).select("id", shift("earliest").alias("earliest"), shift("latest").alias("latest"))



@query("time_attempts", _EVENTS + """, f AS (SELECT *, CASE WHEN type = 'signup' OR coalesce(lag(type) OVER w = 'purchase', true) THEN 1 ELSE 0 END AS b FROM c WINDOW w AS (PARTITION BY source_computer ORDER BY time_created, record_id))
SELECT record_id, CAST(sum(b) OVER (PARTITION BY source_computer ORDER BY time_created, record_id) AS BIGINT) AS attempt FROM f""")
def _(spark, d):
    return timeline.attempts(events(spark, d), ["source_computer"], F.col("type") == "signup", F.col("type") == "purchase").select("record_id", "attempt")


@query("time_pivots", "SELECT event_id AS record_id, 'Actor' AS kind, event_type AS value FROM events UNION ALL SELECT event_id, 'Account', event_type FROM events UNION ALL SELECT event_id, 'Logon', json_extract_string(props, '$.k') FROM events")
def _(spark, d):
    rows = events(spark, d).select("record_id", F.create_map(F.lit("Who"), F.col("type"), F.lit("LogonId"), payload("k")).alias("f"))
    return rows.select("record_id", F.inline(timeline.pivots(F.col("f"))))


_ERRORS = rules.Rule("errors", kind="Threshold", selector=rules.Selector(types=("error",)), threshold=3, window_seconds=432000, group_by="source_computer")


@query("detect_stateless", _EVENTS + "SELECT 'big' AS rule_id, record_id FROM c WHERE type = 'purchase' AND value > 90 UNION ALL SELECT 'bad', record_id FROM c WHERE event_id = 1002 AND NOT (source_computer = '5')")
def _(spark, d):
    made = [rules.Rule("big", selector=rules.Selector(types=("Purchase",), predicate=p.Field("value") > 90)), rules.Rule("bad", selector=rules.Selector(event_ids=(1002,)))]
    found = detect.evaluate(identified(spark, d), made, [rules.Suppression("bad", p.Field("source_computer") == "5")])
    return found.select("rule_id", F.get("evidence", F.lit(0)).cast("long").alias("record_id"))


@query("detect_threshold", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error'),
s AS (SELECT user_id, n, event_id, t, [t] AS held, false AS fired FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.n, e.event_id, e.t, CASE WHEN len(list_filter(s.held, lambda x: x >= e.t - 432000000000)) = 2 THEN [] ELSE list_append(list_filter(s.held, lambda x: x >= e.t - 432000000000), e.t) END, len(list_filter(s.held, lambda x: x >= e.t - 432000000000)) = 2
FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1) SELECT CAST(user_id AS VARCHAR) AS group_value, event_id AS record_id FROM s WHERE fired""")
def _(spark, d):
    return detect.evaluate(identified(spark, d), [_ERRORS]).select("group_value", F.get("evidence", F.size("evidence") - 1).cast("long").alias("record_id"))


def _steps(*types: str) -> tuple[rules.Selector, ...]:
    return tuple(rules.Selector(types=(t,)) for t in types)


@query("detect_explain", _EVENTS + "SELECT record_id, type = 'error' AS type_ok, value > 50 AS predicate_ok FROM c")
def _(spark, d):
    rule = rules.Rule("x", selector=rules.Selector(types=("error",), predicate=p.Field("value") > 50))
    return detect.explain(identified(spark, d), rule).select(F.col("observation_identity").cast("long").alias("record_id"), F.col("conditions.type").alias("type_ok"), F.col("conditions.predicate").alias("predicate_ok"))


@query("detect_impact", _EVENTS + "SELECT 'removed' AS change, record_id FROM c WHERE type = 'error' AND value > 50 AND value <= 80")
def _(spark, d):
    rule = lambda v: [rules.Rule("x", selector=rules.Selector(types=("error",), predicate=p.Field("value") > v))]
    return detect.impact(identified(spark, d), rule(50), rule(80)).select("change", F.get("evidence", F.lit(0)).cast("long").alias("record_id"))


@query("detect_isolated", _EVENTS + "SELECT 'good' AS rule_id, 'Matched' AS status, record_id FROM c WHERE type = 'error' UNION ALL SELECT 'bad', 'Error', arg_min(record_id, time_created) FROM c WHERE type = 'view'")
def _(spark, d):
    made = [rules.Rule("good", selector=rules.Selector(types=("error",))), rules.Rule("bad", selector=rules.Selector(types=("view",), predicate=p.compare("type", "GreaterThan", 5)))]
    return detect.evaluate_isolated(identified(spark, d), made).select("rule_id", "status", F.get("evidence", F.lit(0)).cast("long").alias("record_id"))


@query("detect_bounds", "SELECT * FROM (SELECT 'groups' AS bound, count(DISTINCT user_id) AS value, 10::BIGINT AS allowed FROM events WHERE event_type = 'error' UNION ALL SELECT 'observations', count(*), 100 FROM events) WHERE value > allowed")
def _(spark, d):
    return detect.bounds(identified(spark, d), [_ERRORS], max_groups=10, max_observations=100)


@query("detect_stored", _EVENTS + "SELECT record_id FROM c WHERE type = 'error' AND value > 50 AND time_created >= TIMESTAMP '2024-01-05'")
def _(spark, d):
    made = store.Store(spark, _folder(spark, "detect"))
    made.write(identified(spark, d))
    found = made.detect([rules.Rule("bad", selector=rules.Selector(types=("error",), predicate=p.Field("value") > 50))], start=datetime(2024, 1, 5))
    return found.select(F.get("evidence", F.lit(0)).cast("long").alias("record_id"))


_WINDOWS_LOG = {"click": 4624, "error": 4625, "purchase": 4740, "signup": 4720, "view": 4771}


def windows_log(spark, d):
    """The application events dressed as security events."""
    rows = events(spark, d)
    code = F.coalesce(*[F.when(F.col("type") == t, i) for t, i in _WINDOWS_LOG.items()])
    values = F.create_map(F.lit("TargetUserName"), F.concat(F.lit("user"), "source_computer"), F.lit("TargetDomainName"), F.lit("DOM"), F.lit("LogonType"), (F.col("record_id") % 4).cast("string"), F.lit("IpAddress"), F.when(F.col("record_id") % 3 == 0, "-").otherwise("10.0.0.1"), F.lit("LmPackageName"), F.when(F.col("record_id") % 5 == 0, "NTLM V1").otherwise("-"))
    return canonical(rows.withColumn("event_id", code).withColumn("provider", F.lit("Microsoft-Windows-Security-Auditing")).withColumn("source_log", F.lit("Security")).withColumn("values", values))


@query("view_typed", "SELECT CASE event_type WHEN 'click' THEN CASE WHEN event_id % 5 = 0 THEN 'ADUserLogonNTLMv1' ELSE 'ADUserLogon' END WHEN 'error' THEN 'ADUserLogonFailed' WHEN 'purchase' THEN 'ADUserLockouts' WHEN 'view' THEN 'KerberosTicketFailure' END AS type, count(*) AS count FROM events WHERE event_type <> 'signup' GROUP BY 1")
def _(spark, d):
    return views.typed(windows_log(spark, d), ["ADUserLogonNTLMv1", "ActiveDirectoryAuthentication"]).groupBy("type").agg(F.count(F.lit(1)).alias("count"))


@query("view_defined", "SELECT event_id AS record_id, CAST(event_id % 4 AS INTEGER) AS logon_type, 'user' || user_id AS account, 'x' AS tag FROM events WHERE event_type = 'error'")
def _(spark, d):
    f = views.DefinedField
    return views.defined(windows_log(spark, d), "security", [4625], [f("logon_type", "Data", "logontype", "int"), f("account", "Data", "TargetUserName"), f("tag", "Constant", "x")]).select("record_id", "logon_type", "account", "tag")


@query("view_columns", """SELECT event_id AS record_id, 'DOM\\user' || user_id AS account, CASE event_id % 4 WHEN 0 THEN 'System' WHEN 2 THEN 'Interactive' WHEN 3 THEN 'Network' END AS logon_type, CASE WHEN event_id % 3 = 0 THEN '-' ELSE '10.0.0.1' END AS ip_address FROM events WHERE event_type = 'error'""")
def _(spark, d):
    return views.projected(windows_log(spark, d), "ADUserLogonFailed").select("record_id", "account", "logon_type", "ip_address")


def policy_log(spark, d):
    """The application events dressed as changes of one policy a user: a sign-up names it, an error deletes it, the rest edit it."""
    rows = events(spark, d)
    name = F.col("type") == "signup"
    guid = F.concat(F.lit("{00000000-0000-0000-0000-"), F.lpad("source_computer", 12, "0"), F.lit("}"))
    values = F.create_map(
        F.lit("ObjectClass"), F.lit("groupPolicyContainer"), F.lit("ObjectDN"), F.concat(F.lit("CN="), guid, F.lit(",CN=Policies,CN=System,DC=x")), F.lit("AttributeLDAPDisplayName"), F.when(name, "displayName").otherwise("versionNumber"),
        F.lit("AttributeValue"), F.concat(F.lit("n"), "record_id"), F.lit("OperationType"), F.lit("%%14674"),
    )
    return canonical(rows.withColumn("event_id", F.when(F.col("type") == "error", 5141).otherwise(5136)).withColumn("provider", F.lit("Microsoft-Windows-Security-Auditing")).withColumn("source_log", F.lit("Security")).withColumn("values", values))


@query("policy_audit", """WITH s AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS life FROM events),
n AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN 'n' || event_id END IGNORE NULLS) OVER (PARTITION BY user_id, coalesce(life, 0) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS name, max(ts) OVER (PARTITION BY user_id) AS newest FROM s)
SELECT event_id AS record_id, CASE WHEN event_type = 'error' THEN 'Deleted' ELSE 'Modified' END AS kind, CASE WHEN event_type = 'error' THEN 'Deleted' WHEN ts = newest THEN 'Current' ELSE 'Historical' END AS policy_status, name AS policy_name FROM n""")
def _(spark, d):
    return policy.audit(policy_log(spark, d)).select("record_id", "kind", "policy_status", "policy_name")


@query("report_statistics", _EVENTS + "SELECT 'event_id' AS dimension, CAST(event_id AS VARCHAR) AS value, count(*) AS count FROM c GROUP BY 2 UNION ALL SELECT 'provider', 'app', count(*) FROM c UNION ALL SELECT 'computer', source_computer, count(*) FROM c GROUP BY 2 UNION ALL SELECT 'level', CASE WHEN type = 'error' THEN 'Error' ELSE 'Information' END, count(*) FROM c GROUP BY 2")
def _(spark, d):
    return reports.statistics(events(spark, d))


@query("report_failed_logons", """WITH f AS (SELECT * FROM events WHERE event_type = 'error')
SELECT 'computer' AS dimension, CAST(user_id AS VARCHAR) AS value, count(*) AS count FROM f GROUP BY 2 UNION ALL SELECT 'target_user', 'user' || user_id, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'target_domain', 'DOM', count(*) FROM f
UNION ALL SELECT 'logon_type', CASE event_id % 4 WHEN 0 THEN 'System' WHEN 1 THEN '1' WHEN 2 THEN 'Interactive' ELSE 'Network' END, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'ip', '10.0.0.1', count(*) FROM f WHERE event_id % 3 <> 0""")
def _(spark, d):
    return reports.failed_logons(windows_log(spark, d))


@query("report_lockouts", "SELECT 'target_user' AS dimension, 'user' || user_id AS value, count(*) AS count FROM events WHERE event_type = 'purchase' GROUP BY 2 UNION ALL SELECT 'computer', CAST(user_id AS VARCHAR), count(*) FROM events WHERE event_type = 'purchase' GROUP BY 2 UNION ALL SELECT 'caller', 'DOM', count(*) FROM events WHERE event_type = 'purchase'")
def _(spark, d):
    return reports.lockouts(windows_log(spark, d))


@query("report_rc4", """WITH r AS (SELECT CAST(user_id AS VARCHAR) AS controller, 201 + CAST(event_id % 9 AS INTEGER) AS event_id, ts, event_id AS record_id FROM events)
SELECT controller, event_id, CASE WHEN event_id IN (201, 202, 206, 207) THEN 'MayFailUnderEnforcement' WHEN event_id = 205 THEN 'ExplicitInsecureDefault' ELSE 'AlreadyBlocked' END AS state, count(*) AS count, max(ts) AS last_seen, list(CAST(record_id AS VARCHAR) ORDER BY ts, record_id)[1:25] AS evidence FROM r GROUP BY 1, 2, 3""")
def _(spark, d):
    rows = identified(spark, d).withColumn("event_id", (F.lit(201) + F.col("record_id") % 9).cast("int")).withColumn("provider", F.lit("Kdcsvc")).withColumn("source_log", F.lit("System"))
    return reports.rc4_impact(rows).select("controller", "event_id", "state", "count", "last_seen", "evidence")


@query("report_decisions", _EVENTS + """SELECT * FROM (SELECT 'ObservationCount' AS metric, count(*)::DOUBLE AS value FROM c UNION ALL SELECT 'ChannelCount', 1 UNION ALL SELECT 'AverageReceiveLagSeconds', 5 UNION ALL SELECT 'MaximumReceiveLagSeconds', 5 UNION ALL SELECT 'Errors', count(*) FROM c WHERE type = 'error'
UNION ALL SELECT 'TargetCount', count(DISTINCT source_computer) + 1 FROM c UNION ALL SELECT 'FindingCount', count(*) FROM c WHERE type = 'error' UNION ALL SELECT 'MatchedFindingCount', count(*) FROM c WHERE type = 'error' UNION ALL SELECT 'IncompleteFindingCount', 0 UNION ALL SELECT 'ErrorFindingCount', 0 UNION ALL SELECT 'PackCount', 5)""")
def _(spark, d):
    rows = identified(spark, d).withColumn("received_time", F.col("time_created") + F.expr("INTERVAL 5 SECOND"))
    found = detect.evaluate(rows, [rules.Rule("bad", selector=rules.Selector(types=("error",)))])
    return reports.decision_metrics(rows.unionByName(rows), found, len(rules.BUILT_IN), {"Errors": F.col("type") == "error"})


@query("fn_flags", "SELECT c_custkey, list_filter([CASE WHEN c_custkey & 1 <> 0 THEN 'SCRIPT' END, CASE WHEN c_custkey & 2 <> 0 THEN 'ACCOUNTDISABLE' END, CASE WHEN c_custkey & 8 <> 0 THEN 'HOMEDIR_REQUIRED' END, CASE WHEN c_custkey & 16 <> 0 THEN 'LOCKOUT' END, CASE WHEN c_custkey & 4 <> 0 THEN 'UNKNOWN_0x4' END], lambda x: x IS NOT NULL) AS flags FROM customer WHERE c_custkey < 32")
def _(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").where("c_custkey < 32").select("c_custkey", decode.flags(F.col("c_custkey")).alias("flags"))


@query("fn_filetime", "SELECT o_orderkey, o_orderdate AS time FROM orders")
def _(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", times.from_filetime(F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 10 + F.lit(times.FILETIME_EPOCH)).alias("time"))


@query("fn_generalized_time", "SELECT o_orderkey, o_orderdate - INTERVAL 90 MINUTE AS time FROM orders")
def _(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", times.from_generalized(F.concat(F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit(".0+0130"))).alias("time"))


@query("fn_accounts", "SELECT c_custkey, c_mktsegment AS domain, c_name AS account, c_mktsegment || '\\' || c_name AS whole FROM customer")
def _(spark, d):
    whole = text.compose_account(F.col("c_mktsegment"), F.col("c_name"))
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", text.account_domain(whole).alias("domain"), text.account_user(whole).alias("account"), whole.alias("whole"))


@query("fn_multi_value", "SELECT p_partkey, list_sort(list_distinct([p_brand, p_type])) AS parts FROM part WHERE upper(p_brand) < upper(p_type)")
def _(spark, d):
    joined = F.concat_ws(" ;\n", "p_type", "p_brand", F.lower("p_brand"))
    return spark.read.parquet(f"{d}/part.parquet").where("upper(p_brand) < upper(p_type)").select("p_partkey", text.distinct_values(joined).alias("parts"))


@query("fn_key_values", "SELECT c_custkey, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation FROM customer")
def _(spark, d):
    found = text.key_value_lines(F.concat(F.lit("Name : "), F.col("c_name"), F.lit("\r\nno pair\r\nNation:\t"), F.col("c_nationkey"), F.lit("\nName: again")))
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", found["Name"].alias("name"), F.trim(F.translate(found["Nation"], "\t", "")).alias("nation"))


@query("fn_normalized", """SELECT c_custkey, 'Name' AS field, c_name AS display, 'Text' AS kind, 'Unchanged' AS outcome FROM customer UNION ALL SELECT c_custkey, 'MemberSid', 'S-1-5-' || c_custkey, 'SecurityIdentifier', 'Normalized' FROM customer
UNION ALL SELECT c_custkey, 'SPN', 'a, b' || c_nationkey, 'MultiValue', 'Normalized' FROM customer UNION ALL SELECT c_custkey, 'RowGuid', 'x', 'Guid', 'Malformed' FROM customer UNION ALL SELECT c_custkey, 'OperationType', 'Value Deleted', 'DirectoryOperation', 'Normalized' FROM customer""")
def _(spark, d):
    values = F.create_map(F.lit("Name"), F.col("c_name"), F.lit("MemberSid"), F.concat(F.lit("s-1-5-"), "c_custkey"), F.lit("SPN"), F.concat(F.lit("b"), "c_nationkey", F.lit(";a;A")), F.lit("RowGuid"), F.lit("x"), F.lit("OperationType"), F.lit("%%14675"))
    n = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.explode(normalize.normalized_values(values, F.lit("x"))).alias("field", "n"))
    return n.select("c_custkey", "field", "n.display", "n.kind", "n.outcome")


@query("fn_diagnostic_code", "SELECT p_partkey, printf('0x8007%04X', p_size) AS hex, 7 AS facility, p_size::BIGINT AS win32, 'Failure' AS outcome, CASE p_size WHEN 2 THEN 'HRESULT_FROM_WIN32(ERROR_FILE_NOT_FOUND)' WHEN 3 THEN 'HRESULT_FROM_WIN32(ERROR_PATH_NOT_FOUND)' WHEN 5 THEN 'HRESULT_FROM_WIN32(ERROR_ACCESS_DENIED)' WHEN 32 THEN 'HRESULT_FROM_WIN32(ERROR_SHARING_VIOLATION)' END AS symbol FROM part")
def _(spark, d):
    code = decode.diagnostic_code((F.lit(0x80070000 - (1 << 32)) + F.col("p_size")).cast("string"), "HResult")
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", code.alias("c")).select("p_partkey", "c.hex", "c.facility", "c.win32", "c.outcome", "c.symbol")


@query("fn_policy_links", "SELECT s_suppkey, 'cn={' || s_suppkey || '},dc=x' AS distinguished_name, CAST(s_suppkey AS VARCHAR) AS guid, s_suppkey % 4 & 1 = 0 AS enabled, s_suppkey % 4 & 2 <> 0 AS enforced FROM supplier")
def _(spark, d):
    link = F.concat(F.lit("[LDAP://cn={"), "s_suppkey", F.lit("},dc=x;"), F.col("s_suppkey") % 4, F.lit("]"))
    return spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", F.inline(decode.policy_links(link))).drop("options")


@query("fn_kinds", "SELECT CASE event_id % 8 WHEN 0 THEN 'Guid' WHEN 1 THEN 'SecurityIdentifier' WHEN 2 THEN 'DistinguishedName' WHEN 3 THEN 'ObjectIdentifier' WHEN 4 THEN 'ResourceIdentifier' WHEN 5 THEN 'MultiValue' WHEN 6 THEN 'Text' ELSE 'Unknown' END AS kind, count(*) AS values FROM events GROUP BY 1")
def _(spark, d):
    n = F.col("record_id").cast("string")
    forms = (F.concat(F.lit("{6F9619FF-8B86-D011-B42D-"), F.lpad(n, 12, "0"), F.lit("}")), F.concat(F.lit("S-1-5-21-1-2-3-"), n), F.concat(F.lit("CN=a"), n, F.lit(", DC=b")), F.concat(F.lit("1.2.840."), n), F.concat(F.lit("%%"), n), F.concat(F.lit("a;b"), n), F.concat(F.lit("plain "), n))
    made = F.coalesce(*[F.when(F.col("record_id") % 8 == i, form) for i, form in enumerate(forms)])
    return events(spark, d).select(decode.kind_of(made).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("values"))


@query("src_xml", _EVENTS + "SELECT record_id, event_id, source_computer, time_created, k, 'second' AS unnamed FROM c")
def _(spark, d):
    tag = lambda n, v: F.concat(F.lit(f"<{n}>"), v, F.lit(f"</{n}>"))
    made = F.concat(
        F.lit('<Event xmlns="urn:x"><System><Provider Name="app"/>'), tag("EventID", F.col("event_id")), F.lit("<Level>4</Level>"), F.lit('<TimeCreated SystemTime="'), F.date_format("time_created", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit('"/>'),
        tag("EventRecordID", F.col("record_id")), F.lit("<Channel>Application</Channel>"), tag("Computer", F.col("source_computer")), F.lit('</System><EventData><Data Name="k">'), payload("k"), F.lit("</Data><Data></Data><Data>second</Data></EventData></Event>"),
    )
    rows = files.project_xml(events(spark, d).select(made.alias("raw_xml")))
    return rows.select("record_id", "event_id", "source_computer", "time_created", F.element_at("values", "k").alias("k"), F.element_at("values", "NoNameA1").alias("unnamed"))


@query("store_round_trip", _EVENTS + "SELECT type, count(*) AS count, max(time_created) AS last_seen FROM c WHERE time_created >= TIMESTAMP '2024-01-05' AND type <> 'view' GROUP BY 1")
def _(spark, d):
    made = store.Store(spark, _folder(spark, "store"))
    rows = events(spark, d)
    made.write(rows.where("time_created < TIMESTAMP '2024-01-12'"))
    made.write(rows)
    return made.read(~(p.Field("type") == "view"), start=datetime(2024, 1, 5)).groupBy("type").agg(F.count(F.lit(1)).alias("count"), F.max("time_created").alias("last_seen"))


@query("stream_daily_counts", "SELECT date_trunc('day', ts) AS day, event_type AS type, count(*) AS count FROM events GROUP BY 1, 2")
def _(spark, d):
    import uuid

    schema = spark.read.parquet(f"{d}/events.parquet").schema
    rows = from_app_events(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d))
    name = f"daily_{uuid.uuid4().hex}"
    running = streams.daily_counts(rows).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(name)


@query("time_observed_windows", "SELECT 'collector' AS collector_computer, 'Application' AS source_log, min(ts) AS start, max(ts) AS \"end\", count(*) AS events FROM events")
def _(spark, d):
    return timeline.observed_windows(events(spark, d))


@query("src_observations", "SELECT count(DISTINCT event_id) AS identities, count(*) AS rows FROM events")
def _(spark, d):
    rows = observed(events(spark, d))
    return rows.agg(F.countDistinct("observation_identity").alias("identities"), F.count_if(F.col("fields")["SourceComputer"] == F.col("source_computer")).alias("rows"))


from chronolith.plans import flows, more, reported  # noqa: E402,F401 (they register their queries and need the helpers above)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
