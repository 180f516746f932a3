import time
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronolith.operators import detect, rules
from chronolith.plans import catalogue, more  # noqa: F401 - the catalogue imports the others
from chronolith.schema import CANONICAL, canonical
from chronolith.sources.store import Store
from chronolith.streaming import streams

T0 = datetime(2024, 1, 1)


def rows(spark, items):
    data = [(i, int(i), T0 + timedelta(seconds=s), "a", {"g": g}) for i, s, g in items]
    return canonical(spark.createDataFrame(data, "observation_identity string, record_id long, time_created timestamp, type string, values map<string,string>"))


def feed(spark, tmp_path, batches):
    for b in batches:
        rows(spark, b).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are taken by their age
    return spark.readStream.schema(CANONICAL).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def run(spark, df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_threshold_stream_equals_batch(spark, tmp_path):
    batches = [[("1", 0, "x"), ("2", 5, "x")], [("3", 10, "x"), ("4", 11, "y")], [("5", 12, "x"), ("6", 13, "x"), ("7", 14, "x"), ("8", 900, "y")]]
    rule = rules.Rule("t", kind="Threshold", selector=rules.Selector(types=("a",)), threshold=3, window_seconds=10, group_by="g")
    got = run(spark, streams.rule_findings(feed(spark, tmp_path, batches), rule), tmp_path, "found")
    batch = detect.evaluate(rows(spark, [e for b in batches for e in b]), [rule])
    assert sorted(tuple(r["evidence"]) for r in got.collect()) == sorted(tuple(r["evidence"]) for r in batch.collect()) == [("1", "2", "3"), ("5", "6", "7")]


def test_replay_goes_on_and_refuses_another_plan(spark, tmp_path):
    rule = rules.Rule("t", kind="Threshold", selector=rules.Selector(types=("a",)), threshold=2, window_seconds=10, group_by="g")
    store = Store(spark, f"file://{tmp_path}/s")
    src = feed(spark, tmp_path, [[("1", 0, "x")]])
    streams.replay(src, rule, store, "r", f"{tmp_path}/c", availableNow=True).awaitTermination()
    src = feed(spark, tmp_path, [[("2", 5, "x")]])
    streams.replay(src, rule, store, "r", f"{tmp_path}/c", availableNow=True).awaitTermination()
    assert [r["evidence"] for r in store.findings().collect()] == [["1", "2"]]
    with pytest.raises(ValueError):
        streams.replay(src, replace(rule, threshold=3), store, "r", f"{tmp_path}/c", availableNow=True)


def test_absence_stream_fires_when_the_watermark_passes(spark, tmp_path):
    batches = [[("1", 0, "x"), ("2", 3, "y")], [("3", 5, "x")], [("4", 5000, "z")], [("5", 9000, "z")]]
    src = feed(spark, tmp_path, batches).withColumn("type", F.when(F.col("record_id") == 3, "b").when(F.col("record_id") > 3, "c").otherwise("a"))
    rule = rules.Rule("n", kind="Absence", steps=(rules.Selector(types=("a",)), rules.Selector(types=("b", "c"))), window_seconds=10, group_by="g")
    got = run(spark, streams.rule_findings(src, rule, "1 second"), tmp_path, "silent").collect()
    assert [(r["group_value"], r["evidence"], r["event_us"]) for r in got] == [("Y", ["2"], int((T0 - datetime(1970, 1, 1)).total_seconds() * 1e6) + 13_000_000)]


def test_delivery_windows_and_store(spark, tmp_path):
    batches = [[("1", 0, "x"), ("2", 5, "x")], [("1", 0, "x"), ("3", 7300, "x")]]
    src = feed(spark, tmp_path, batches)
    assert sorted(r["observation_identity"] for r in run(spark, streams.delivered_once(src), tmp_path, "once").collect()) == ["1", "2", "3"]
    assert [r["count"] for r in run(spark, streams.windowed_counts(src), tmp_path, "win").collect()] == [3]
    store = Store(spark, f"file://{tmp_path}/store")
    for _ in range(2):
        streams.ingest(src, store, f"{tmp_path}/cp", availableNow=True).awaitTermination()
    assert store.read().count() == 3
    dead = f"{tmp_path}/dead"

    def fail(df, batch):
        raise RuntimeError("no")

    streams.outbox(src, fail, dead, f"{tmp_path}/cp2", availableNow=True).awaitTermination()
    assert spark.read.parquet(dead).where(F.col("error") == "no").count() == 4
    w = streams.Watchers()
    w.start("a", lambda: src.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/cp3").start())
    assert w.states() == {"a": True}
    w.stop()
    assert w.states() == {}


def test_late_rows_are_reported_or_fail_the_stream(spark, tmp_path):
    batches = [[("1", 0, "x"), ("2", 100, "x")], [("3", 50, "x"), ("4", 95, "x"), ("5", 200, "x")]]
    store = Store(spark, f"file://{tmp_path}/s")
    seen, late = [], []
    keep = lambda into: lambda df, batch: into.extend(r["observation_identity"] for r in df.collect())
    source = feed(spark, tmp_path, batches)
    streams.reporting_late(source, keep(seen), keep(late), timedelta(seconds=10), store, "w", f"{tmp_path}/at", availableNow=True).awaitTermination()
    assert sorted(seen) == ["1", "2", "4", "5"] and late == ["3"]
    with pytest.raises(Exception, match="behind the watermark"):
        streams.reporting_late(source, keep([]), None, timedelta(seconds=10), Store(spark, f"file://{tmp_path}/t"), "w", f"{tmp_path}/at2", availableNow=True).awaitTermination()


def test_a_stream_without_the_group_field_says_so(spark, tmp_path):
    rule = rules.Rule("t", kind="Threshold", selector=rules.Selector(types=("a",)), threshold=2, window_seconds=10, group_by="nothing")
    got = run(spark, streams.lacking(feed(spark, tmp_path, [[("1", 0, "x"), ("2", 1, "x")]]), rule), tmp_path, "lacking").collect()
    assert [(r["rule_id"], r["status"], r["field"]) for r in got] == [("t", "Incomplete", "nothing")]


def test_a_streams_result_is_written_by_tasks(spark, tmp_path):
    src = feed(spark, tmp_path, [[("1", 0, "x"), ("2", 5, "x"), ("1", 0, "x")]])
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    once = more._table(spark, streams.delivered_once(src))
    assert sorted(r["observation_identity"] for r in once.collect()) == ["1", "2"] and once.inputFiles()
    counts = more._table(spark, streams.windowed_counts(src), "complete")
    assert [r["count"] for r in counts.collect()] == [3] and counts.inputFiles()
    assert spark.conf.get(key) == was
