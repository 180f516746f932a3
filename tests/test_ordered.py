"""Streams in disorder and replay sessions against the batch detector."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronolith.operators import detect, rules
from chronolith.schema import CANONICAL, canonical
from chronolith.sources.store import Store
from chronolith.streaming import ordered, streams
from chronolith.streaming.replay import InvalidReplay, ReplaySession

T0 = datetime(2024, 1, 1)


def rows(spark, items):
    data = [(f"e{i}", int(i), T0 + timedelta(seconds=s), t, {"g": g} if g else {}) for i, s, t, g in items]
    return canonical(spark.createDataFrame(data, "observation_identity string, record_id long, time_created timestamp, type string, values map<string,string>"))


def put(spark, folder, batch):
    batch.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    time.sleep(1.1)  # files are taken by their age


def source(spark, folder):
    return spark.readStream.schema(CANONICAL).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def run(spark, df, folder, name):
    df.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-at").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(ordered.FOUND).parquet(f"{folder}/{name}")


def steps(*types):
    return tuple(rules.Selector(types=(t,)) for t in types)


RULES = [
    rules.Rule("t", kind="Threshold", selector=rules.Selector(types=("a",)), threshold=3, window_seconds=25, group_by="g"),
    rules.Rule("o", kind="OrderedTemporal", steps=steps("a", "b"), window_seconds=30, group_by="g"),
    rules.Rule("n", kind="Absence", steps=steps("a", "b"), window_seconds=15, group_by="g"),
]


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    ordered.use_rocksdb(spark)
    yield
    spark.conf.set(key, was)


def found(df):
    return sorted((r["rule_id"], r["group_value"], r["event_us"], tuple(r["evidence"])) for r in df.where("status = 'Matched'").collect())


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.kind)
def test_disorder_inside_the_window_gives_the_findings_of_the_batch(spark, tmp_path, rocksdb, rule):
    rng = random.Random(7)
    items = [(str(i), rng.randint(0, 300), rng.choice("aab"), rng.choice("xyz")) for i in range(90)]
    arriving = sorted(items, key=lambda e: e[1] + rng.random() * 40)
    for at in range(0, 90, 30):
        put(spark, tmp_path, rows(spark, arriving[at : at + 30]))
    put(spark, tmp_path, ordered.heartbeat(spark, T0 + timedelta(days=1)))
    got = run(spark, ordered.reordered_findings(source(spark, tmp_path), rule, "60 seconds"), tmp_path, "out")
    batch = detect.evaluate(rows(spark, items), [rule], until=T0 + timedelta(hours=23)).withColumn("event_us", F.unix_micros("event_time"))
    assert found(got) == found(batch) and found(got) and got.where("note IS NOT NULL").count() == 0


def test_late_rows_come_out_or_fail_and_a_restart_goes_on(spark, tmp_path, rocksdb):
    put(spark, tmp_path, rows(spark, [("1", 0, "a", "x"), ("2", 100, "a", "x")]))
    late = ordered.reordered_findings(source(spark, tmp_path), RULES[0], "20 seconds")
    assert run(spark, late, tmp_path, "out").count() == 0
    put(spark, tmp_path, rows(spark, [("3", 79.9, "a", "x"), ("4", 80, "a", "x"), ("5", 90, "a", "x")]))  # 80 is the watermark
    put(spark, tmp_path, ordered.heartbeat(spark, T0 + timedelta(days=1)))
    got = {(r["status"], r["note"], tuple(r["evidence"])) for r in run(spark, ordered.reordered_findings(source(spark, tmp_path), RULES[0], "20 seconds"), tmp_path, "out").collect()}
    assert got == {("Incomplete", "late", ("e3",)), ("Matched", None, ("e4", "e5", "e2"))}
    with pytest.raises(Exception, match="behind the watermark"):
        run(spark, ordered.reordered_findings(source(spark, tmp_path), RULES[0], "20 seconds", late="fail"), tmp_path, "strict")
    with pytest.raises(ValueError):
        ordered.reordered_findings(source(spark, tmp_path), RULES[0], late="drop")


def test_bounds_of_buffer_and_state_report(spark, tmp_path, rocksdb):
    put(spark, tmp_path, rows(spark, [(str(i), i, "a", "x") for i in range(6)]))
    put(spark, tmp_path, ordered.heartbeat(spark, T0 + timedelta(days=1)))
    got = run(spark, ordered.reordered_findings(source(spark, tmp_path), RULES[0], "20 seconds", max_buffered=4), tmp_path, "small").collect()
    assert sorted((r["status"], r["note"] or "", len(r["evidence"])) for r in got) == [("Incomplete", "buffer", 1), ("Incomplete", "buffer", 1), ("Matched", "", 3)]
    got = run(spark, ordered.reordered_findings(source(spark, tmp_path), RULES[0], "20 seconds", max_held=2), tmp_path, "full").collect()
    assert [(r["status"], r["note"]) for r in got] == [("Incomplete", "state")]


def test_state_bound_of_the_batch_detector_gives_one_incomplete(spark):
    rule = rules.Rule("big", kind="Threshold", selector=rules.Selector(types=("a",)), threshold=260_000, window_seconds=10**6, group_by="g")
    many = spark.range(300_000).select(F.col("id").cast("string").alias("observation_identity"), F.col("id").alias("record_id"), F.timestamp_micros(F.col("id") * 10).alias("time_created"), F.lit("a").alias("type"), F.create_map(F.lit("g"), F.lit("x")).alias("values"))
    got = detect.evaluate(canonical(many), [rule]).collect()  # 250,000 observations are held, then there is no room
    assert [(r["rule_id"], r["group_value"], r["status"], len(r["evidence"])) for r in got] == [("big", None, "Incomplete", 0)]


def test_a_batch_done_before_a_crash_is_passed_over(spark, tmp_path):
    for b in ([("1", 0, "a", "x"), ("2", 100, "a", "x")], [("3", 50, "a", "x"), ("4", 200, "a", "x")]):
        put(spark, tmp_path, rows(spark, b))
    store, seen, late = Store(spark, f"file://{tmp_path}/s"), [], []
    keep = lambda into: lambda df, batch: into.extend(r["observation_identity"] for r in df.collect())
    start = lambda: streams.reporting_late(source(spark, tmp_path), keep(seen), keep(late), timedelta(seconds=10), store, "w", f"{tmp_path}/at", availableNow=True).awaitTermination()
    start()
    (tmp_path / "at" / "commits" / "1").unlink()  # the batch was handled, the commit was not written
    (tmp_path / "at" / "commits" / ".1.crc").unlink(missing_ok=True)
    start()
    put(spark, tmp_path, rows(spark, [("5", 150, "a", "x"), ("6", 195, "a", "x")]))
    start()
    assert sorted(seen) == ["e1", "e2", "e4", "e6"] and late == ["e3", "e5"]


def test_replay_in_portions_equals_the_batch(spark, tmp_path):
    rng = random.Random(3)
    made = [*RULES, rules.Rule("s", selector=rules.Selector(types=("b",)))]
    items = sorted(((str(i), rng.randint(0, 300), rng.choice("aabc"), rng.choice("xyz")) for i in range(120)), key=lambda e: (e[1], int(e[0])))
    store = Store(spark, f"file://{tmp_path}/s")
    got = []
    for at in range(0, 120, 40):
        session = ReplaySession(store, "r", made, "all", "g1")  # each portion in a session of its own
        got += session.process(rows(spark, items[max(0, at - 1) : at + 40])).collect()  # the boundary is read again
    assert session.position().processed == 120 and session.state().count() > 0
    got += session.advance(T0 + timedelta(seconds=1000)).collect()
    got += session.complete().collect()
    batch = detect.evaluate(rows(spark, items), made, until=T0 + timedelta(seconds=1000)).collect()
    shown = lambda found: sorted((r["rule_id"], r["group_value"], r["status"], str(r["event_time"]), tuple(r["evidence"])) for r in found)
    assert shown(got) == shown(batch) == shown(store.findings().collect())
    with pytest.raises(InvalidReplay, match="complete"):
        session.process(rows(spark, items))


def test_replay_is_invalid_after_disorder(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    session = ReplaySession(store, "r", RULES, "all", "g1")
    session.process(rows(spark, [("1", 0, "a", "x"), ("2", 10, "a", "x")]))
    assert session.process(rows(spark, [("2", 10, "a", "x")])).count() == 0
    session.advance(T0 + timedelta(seconds=60))
    with pytest.raises(ValueError, match="move back"):
        session.advance(T0 + timedelta(seconds=50))
    with pytest.raises(InvalidReplay, match="final coverage"):
        session.process(rows(spark, [("3", 59, "a", "x")]))
    assert session.position().invalid
    with pytest.raises(InvalidReplay):
        ReplaySession(store, "r", RULES, "all", "g1").process(rows(spark, [("9", 999, "a", "x")]))
    for other in ({"rules": RULES[:1], "source": "all", "retention": "g1"}, {"rules": RULES, "source": "some", "retention": "g1"}, {"rules": RULES, "source": "all", "retention": "g2"}):
        with pytest.raises(InvalidReplay, match="another"):
            ReplaySession(store, "r", **other)
    again = ReplaySession(store, "q", RULES, "all", "g1")
    again.process(rows(spark, [("5", 50, "a", "x")]))
    with pytest.raises(InvalidReplay, match="older"):
        again.process(rows(spark, [("4", 50, "a", "x")]))
    third = ReplaySession(store, "z", RULES, "all", "g1")
    assert [r["status"] for r in third.process(rows(spark, [("1", 0, "c", "x"), ("2", 5, "a", None)])).collect()] == ["Incomplete"] * 3
    assert third.position().invalid == "a finding is incomplete"


def test_arrivals_of_any_day_are_dealt_to_files(spark, tmp_path):
    from chronolith.plans import catalogue, flows  # noqa: F401 - the catalogue imports the others

    seen = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    seen.withColumn("ts", F.when(F.col("event_id") % 2 == 0, F.col("ts") + F.expr("INTERVAL 60 DAYS")).otherwise(F.col("ts"))).write.parquet(f"file://{tmp_path}/events.parquet")
    folder, chunks = flows._disordered(spark, f"file://{tmp_path}")
    counts = [flows._stream(spark, folder, n).count() for n in chunks]
    assert sum(counts) == seen.count() + 1 and counts[-1] == 1 and max(chunks) > 6
