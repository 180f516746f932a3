"""Registered queries on large rule sets, streams in disorder, replay, logs, entities, the outbox and composed text."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.operators import aggregate as agg
from chronolith.operators import detect, rules
from chronolith.operators import predicates as p
from chronolith.plans.catalogue import _ERRORS, _EVENTS, _folder, _steps, events, identified, query
from chronolith.plans.more import _ABSENCE, _shown
from chronolith.schema import CANONICAL
from chronolith.sources import logs, store
from chronolith.streaming import ordered, outbox, replay

# A rule set that no single projection could test: four shapes of predicates, ids, types and channels.

_TYPES = ("click", "error", "purchase", "signup", "view")
_MANY = 200


def _many_rules() -> list[rules.Rule]:
    out = []
    for i in range(_MANY):
        value, k = p.Field("value"), p.Field("k")
        predicate = [value > float(i), (value <= float(i)) & (k == str(i % 100)), ~(value > float(i)) & k.in_(str(i % 100), str((i + 1) % 100)), k.starts_with(str(i % 10))][i % 4]
        where = {"event_ids": (1001 + i % 5,)} if i % 2 else {"types": (_TYPES[i % 5].upper(),), "channels": ("APPLICATION",) if i % 3 else ()}
        out.append(rules.Rule(f"m{i}", selector=rules.Selector(predicate=predicate, **where)))
    return out


@query(
    "detect_many_rules",
    _EVENTS + f"""SELECT 'm' || i AS rule_id, count(*) AS findings, sum(record_id)::BIGINT AS records FROM c JOIN range({_MANY}) r(i)
ON CASE WHEN i % 2 = 1 THEN event_id = 1001 + i % 5 ELSE type = ['click', 'error', 'purchase', 'signup', 'view'][1 + i % 5] END
AND CASE i % 4 WHEN 0 THEN value > i WHEN 1 THEN value <= i AND k = CAST(i % 100 AS VARCHAR) WHEN 2 THEN value <= i AND k IN (CAST(i % 100 AS VARCHAR), CAST((i + 1) % 100 AS VARCHAR)) ELSE starts_with(k, CAST(i % 10 AS VARCHAR)) END GROUP BY i""",
)
def _(spark, d):
    found = detect.evaluate(identified(spark, d), _many_rules())
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"), F.sum(F.get("evidence", F.lit(0)).cast("long")).alias("records"))


@query(
    "detect_state_bound",
    "SELECT 'held' AS rule_id, 'Incomplete' AS status, ts AS event_time, 0::BIGINT AS evidence FROM (SELECT ts, row_number() OVER (ORDER BY ts, event_id) AS n, count(*) OVER () AS every FROM events WHERE event_type = 'signup') WHERE n = 21 AND every >= 50",
)
def _(spark, d):
    rule = rules.Rule("held", kind="Threshold", selector=rules.Selector(types=("signup",)), threshold=50, window_seconds=40 * 86_400)
    return detect.evaluate(identified(spark, d), [rule], max_held=20).select("rule_id", "status", "event_time", F.size("evidence").cast("long").alias("evidence"))


# Events arrive up to six hours late, in files of ten days of arrivals.

_JITTER = "(event_id * 7919) % 21600"
_CHUNK = f"CAST(floor((epoch_us(ts) / 1e6 + {_JITTER} - 1704067200) / 864000) AS BIGINT)"


def _disordered(spark: SparkSession, d: str) -> tuple[str, list[int]]:
    """A folder with the events in files by arrival and the chunks that there are, the last a heartbeat behind them."""
    folder = _folder(spark, "disorder")
    arrival = F.unix_micros("time_created") / 1e6 + (F.col("record_id") * 7919) % 21600
    rows = identified(spark, d).select(*CANONICAL.fieldNames(), F.floor((arrival - 1704067200) / 864_000).alias("part")).where("part IS NOT NULL")
    rows.write.partitionBy("part").parquet(folder)
    chunks = [(r["part"], r["top"]) for r in spark.read.schema(rows.schema).parquet(folder).groupBy("part").agg(F.max("time_created").alias("top")).orderBy("part").collect()]  # one a ten days
    last = max((n for n, _ in chunks), default=0) + 1
    beat = max([datetime(2025, 1, 1), *(top + timedelta(days=30) for _, top in chunks)])
    ordered.heartbeat(spark, beat).coalesce(1).write.parquet(f"{folder}/part={last}")
    return folder, [*(n for n, _ in chunks), last]


def _stream(spark: SparkSession, folder: str, chunk: int) -> DataFrame:
    return spark.read.schema(CANONICAL).parquet(f"{folder}/part={chunk}")


def _ran(spark: SparkSession, d: str, rule: rules.Rule, window: str) -> DataFrame:
    """A rule over the arriving files, a micro-batch each; the folder of results is read when the stream has ended."""
    key = "spark.sql.streaming.stateStore.providerClass"
    was, (folder, chunks), out = spark.conf.get(key), _disordered(spark, d), _folder(spark, "reordered")
    ordered.use_rocksdb(spark)
    try:
        for n in chunks:  # the stream is started anew for each file: it goes on from its checkpoint
            _append(spark, _stream(spark, folder, n), f"{out}/in")
            rows = spark.readStream.schema(CANONICAL).parquet(f"{out}/in")
            found = ordered.reordered_findings(rows, rule, window)
            found.writeStream.format("parquet").option("path", f"{out}/found").option("checkpointLocation", f"{out}/at").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, was)
    return spark.read.schema(ordered.FOUND).parquet(f"{out}/found")


def _append(spark: SparkSession, rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def _threshold_sql(kept: str) -> str:
    """The findings of ``_ERRORS`` over rows (user_id, event_id, ts)."""
    held = "list_filter(s.held, lambda x: x >= e.t - 432000000000)"
    return f"""e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {kept}),
s AS (SELECT user_id, n, event_id, t, [t] AS held, false AS fired FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.n, e.event_id, e.t, CASE WHEN len({held}) = 2 THEN [] ELSE list_append({held}, e.t) END, len({held}) = 2 FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)"""


@query("stream_reordered", "WITH RECURSIVE " + _threshold_sql("(SELECT * FROM events WHERE event_type = 'error')") + " SELECT CAST(user_id AS VARCHAR) AS group_value, 'Matched' AS status, NULL::VARCHAR AS note, event_id AS record_id FROM s WHERE fired")
def _(spark, d):
    return _ran(spark, d, _ERRORS, "6 hours").select("group_value", "status", "note", F.get("evidence", F.size("evidence") - 1).cast("long").alias("record_id"))


@query(
    "stream_late_rows",
    f"""WITH RECURSIVE a AS (SELECT *, {_CHUNK} AS chunk FROM events), m AS (SELECT chunk, max(ts) AS top FROM a GROUP BY 1),
w AS (SELECT x.*, (SELECT floor(epoch_us(max(m.top)) / 1000) * 1000 - 3600000000 FROM m WHERE m.chunk < x.chunk) AS mark FROM a x WHERE event_type = 'error'),
l AS (SELECT *, coalesce(epoch_us(ts) < mark, false) AS late FROM w), """
    + _threshold_sql("(SELECT * FROM l WHERE NOT late)")
    + " SELECT CAST(user_id AS VARCHAR) AS group_value, 'Matched' AS status, NULL AS note, event_id AS record_id FROM s WHERE fired UNION ALL SELECT CAST(user_id AS VARCHAR), 'Incomplete', 'late', event_id FROM l WHERE late",
)
def _(spark, d):
    return _ran(spark, d, _ERRORS, "1 hour").select("group_value", "status", "note", F.get("evidence", F.size("evidence") - 1).cast("long").alias("record_id"))


@query("replay_portions", _ABSENCE)
def _(spark, d):
    rows, made = identified(spark, d), store.Store(spark, _folder(spark, "replay"))
    silent = [rules.Rule("silent", kind="Absence", steps=_steps("signup", "purchase"), window_seconds=259200, group_by="source_computer")]
    cuts = [datetime(2024, 1, 1), datetime(2024, 1, 11), datetime(2024, 1, 21), datetime(2025, 1, 1)]
    for start, end in zip(cuts, cuts[1:]):  # a session of its own for each portion
        replay.ReplaySession(made, "events", silent, "all", "first").process(rows.where((F.col("time_created") >= F.lit(start)) & (F.col("time_created") < F.lit(end))))
    session = replay.ReplaySession(made, "events", silent, "all", "first")
    session.advance(datetime(1970, 1, 1) + timedelta(microseconds=session.position().last_us))
    session.complete()
    return _shown(made.findings())


@query(
    "replay_invalid",
    "WITH RECURSIVE " + _threshold_sql("(SELECT * FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-21')")
    + " SELECT (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-21') AS processed, (SELECT count(*) FROM s WHERE fired) AS findings, (SELECT count(*) FROM events WHERE ts < TIMESTAMP '2024-01-11') || ' rows predate the final coverage time' AS invalid",
)
def _(spark, d):
    """A portion, a final time, and then rows from before it: the session keeps what it found and takes nothing more."""
    rows, made = identified(spark, d), store.Store(spark, _folder(spark, "replay"))
    session = replay.ReplaySession(made, "events", [_ERRORS], "all", "first")
    session.process(rows.where("time_created >= TIMESTAMP '2024-01-11' AND time_created < TIMESTAMP '2024-01-21'"))
    session.advance(datetime(2024, 1, 11))
    try:
        session.process(rows.where("time_created < TIMESTAMP '2024-01-11'"))
    except replay.InvalidReplay:
        pass
    now = session.position()
    return made.findings().agg(F.lit(now.processed).cast("long").alias("processed"), F.count(F.lit(1)).alias("findings"), F.lit(now.invalid).alias("invalid"))


# Text logs written from the events: a record a row, every third with a second line.


def _log_text() -> Column:
    more = F.when(F.col("record_id") % 3 == 0, F.concat(F.lit("\n  k="), F.col("k"))).otherwise("")
    return F.concat(F.date_format("time_created", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" ["), F.upper("level"), F.lit("] event "), F.col("record_id").cast("string"), more)


_LOG_SQL = _EVENTS + "SELECT record_id, time_created AS time, CASE WHEN type = 'error' THEN 'ERROR' ELSE 'INFORMATION' END AS level, 'event ' || record_id || CASE WHEN record_id % 3 = 0 THEN chr(10) || '  k=' || k ELSE '' END AS text FROM c"


def _records(rows: DataFrame) -> DataFrame:
    return rows.select(F.regexp_extract("text", r"event (\d+)", 1).cast("long").alias("record_id"), "time", "level", "text")


@query("src_log_reader", _LOG_SQL)
def _(spark, d):
    """The data source in batch, its files cut into ranges of 100 kB."""
    folder = _folder(spark, "logs")
    events(spark, d).select(_log_text().alias("value")).write.text(folder)
    logs.register(spark)
    return _records(spark.read.format("chronolith_log").option("path", folder).option("range_bytes", 100_000).load())


@query("src_log_stream", _LOG_SQL)
def _(spark, d):
    """The data source as a stream that is stopped and goes on: each record comes once."""
    folder, out = _folder(spark, "logs"), _folder(spark, "log-records")
    logs.register(spark)
    rows = events(spark, d)
    for part, final in ((F.col("record_id") % 2 == 0, False), (F.col("record_id") % 2 == 1, True)):
        rows.where(part).select(_log_text().alias("value")).write.mode("append").text(folder)
        met = spark.readStream.format("chronolith_log").option("path", folder).option("final", final).load()
        met.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-at").trigger(availableNow=True).start().awaitTermination()
    return _records(spark.read.schema(logs.SCHEMA).parquet(out))


@query("store_finding_entities", "SELECT 'bad' AS rule_id, event_id AS record_id FROM events WHERE event_type = 'error' AND user_id BETWEEN 5 AND 7")
def _(spark, d):
    """Findings by computer: for each of three a look-up that reads one bucket of the entity table."""
    made, rows = store.Store(spark, _folder(spark, "entities")), identified(spark, d)
    bad = [rules.Rule("bad", selector=rules.Selector(types=("error",)))]
    plain = detect.evaluate(rows, bad).withColumn("_id", F.get("evidence", F.lit(0)))
    who = rows.select(F.col("observation_identity").alias("_id"), F.array(F.struct(F.lit("Computer").alias("kind"), F.col("source_computer").alias("value"))).alias("entities"))
    made.write_findings(plain.join(who, "_id").drop("_id"))
    found = [made.findings_about(str(user), "computer") for user in (5, 6, 7)]
    return found[0].union(found[1]).union(found[2]).select("rule_id", F.get("evidence", F.lit(0)).cast("long").alias("record_id"))


@query(
    "sink_outbox_states",
    "SELECT CASE WHEN value > 100 THEN 'dead' ELSE 'delivered' END AS state, CASE WHEN value > 100 THEN 3 WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS attempts, CASE WHEN value > 100 THEN 'too large' END AS error, count(*) AS messages FROM events WHERE event_type = 'error' GROUP BY ALL",
)
def _(spark, d):
    """Error events as messages: large values are never taken, even ids only at the second try."""
    box = outbox.Outbox(spark, _folder(spark, "outbox"), attempts=3, backoff=timedelta(seconds=10))
    rows = events(spark, d).where("type = 'error'")
    box.put(rows.select(F.col("record_id").cast("string").alias("message_id"), F.col("value").cast("string").alias("payload")), datetime(2024, 2, 1))

    def hand_over(taken: DataFrame) -> DataFrame:
        large, number = F.col("payload").cast("double") > 100, F.col("message_id").cast("long")
        ok = ~large & ((number % 2 == 1) | (F.col("attempts") > 0))
        return taken.select("message_id", ok.alias("ok"), F.when(large, "too large").when(~ok, "busy").alias("error"))

    for minute in range(4):
        box.deliver(hand_over, datetime(2024, 2, 1, 0, minute))
    return box.states().groupBy("state", "attempts", "error").agg(F.count(F.lit(1)).alias("messages"))


@query(
    "agg_composed",
    "SELECT min(name) AS name, count(*) AS count, count(DISTINCT upper(nfc_normalize(mark))) AS marks FROM (SELECT event_type || CASE WHEN event_id % 2 = 0 THEN chr(233) ELSE 'e' || chr(769) END AS name, CASE event_id % 4 WHEN 0 THEN chr(197) WHEN 1 THEN 'a' || chr(778) WHEN 2 THEN chr(7879) ELSE 'e' || chr(803) || chr(770) END AS mark FROM events) GROUP BY upper(nfc_normalize(name))",
)
def _(spark, d):
    """Names whose accent is a letter's or a mark of its own are one group, and marks one value."""
    n = F.col("record_id")
    accent = F.when(n % 2 == 0, "\u00e9").otherwise("e\u0301")
    mark = F.when(n % 4 == 0, "\u00c5").when(n % 4 == 1, "a\u030a").when(n % 4 == 2, "\u1ec7").otherwise("e\u0323\u0302")
    rows = events(spark, d).withColumn("name", F.concat("type", accent)).withColumn("mark", mark)
    return agg.aggregate(rows, agg.Definition(("name",), (agg.Measure("Count", "count"), agg.Measure("DistinctCount", "marks", "mark"))))
