"""Findings by entity, the outbox, composed text."""

import unicodedata
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronolith.functions import text
from chronolith.operators import aggregate
from chronolith.schema import canonical
from chronolith.sources.store import Store
from chronolith.streaming.outbox import Outbox

T0 = datetime(2024, 1, 1)


def test_findings_by_entity_read_one_bucket(spark, tmp_path):
    made = [("r", f"g{i}", "Matched", T0 + timedelta(seconds=i), [f"e{i}"], [("Computer", f"pc{i % 7}"), ("Account", "bob" if i % 2 else "Alice"), ("Actor", None)]) for i in range(30)]
    schema = "rule_id string, group_value string, status string, event_time timestamp, evidence array<string>, entities array<struct<kind:string,value:string>>"
    store = Store(spark, f"file://{tmp_path}/s")
    with pytest.raises(ValueError):
        store.findings_about("bob")
    for _ in range(2):  # again: nothing is added
        store.write_findings(spark.createDataFrame(made, schema))
    assert store.findings().count() == 30
    assert sorted(r["group_value"] for r in store.findings_about("PC3", "computer").collect()) == sorted(f"g{i}" for i in range(30) if i % 7 == 3)
    assert store.findings_about("ALICE").count() == 15 and store.findings_about("alice", "Computer").count() == 0
    plan = store.findings_about("alice")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(value_key), EqualTo(value_key,ALICE)" in plan
    copy = store.backup(f"file://{tmp_path}/copy")
    assert Store(spark, f"file://{tmp_path}/copy").verify(copy) and "finding_entities" in copy


def test_outbox_delivers_each_once_and_buries(spark, tmp_path):
    box = Outbox(spark, f"file://{tmp_path}/o", attempts=3, backoff=timedelta(seconds=10), lease=timedelta(seconds=60))
    rows = spark.createDataFrame([("good", "a"), ("late", "b"), ("bad", "c"), ("good", "a"), (None, "x")], "message_id string, payload string")
    for _ in range(2):
        box.put(rows, T0)
    sent = []

    def hand_over(df):
        sent.extend((r["message_id"], r["attempts"]) for r in df.collect())
        ok = (F.col("message_id") == "good") | (F.col("message_id") == "late") & (F.col("attempts") > 0)
        return df.select("message_id", ok.alias("ok"), F.when(~ok, F.lit("no")).alias("error"))

    def dies(df):
        df.collect()
        raise RuntimeError("the sink is gone")

    assert box.ready(T0 - timedelta(seconds=1)).count() == 0
    with pytest.raises(RuntimeError):
        box.deliver(dies, T0)
    assert {r["state"] for r in box.states().collect()} == {"leased"} and box.ready(T0 + timedelta(seconds=59)).count() == 0
    clock = T0 + timedelta(seconds=60)  # the leases end
    assert {r["message_id"]: r["state"] for r in box.deliver(hand_over, clock).collect()} == {"good": "delivered", "late": "pending", "bad": "pending"}
    assert box.deliver(hand_over, clock + timedelta(seconds=9)).count() == 0
    box.deliver(hand_over, clock + timedelta(seconds=10))
    assert box.deliver(hand_over, clock + timedelta(seconds=29)).count() == 0  # the wait has doubled
    box.deliver(hand_over, clock + timedelta(seconds=30))
    assert box.deliver(hand_over, clock + timedelta(days=9)).count() == 0
    assert sorted(sent) == [("bad", 0), ("bad", 1), ("bad", 2), ("good", 0), ("late", 0), ("late", 1)]
    assert {r["message_id"]: (r["state"], r["attempts"], r["error"]) for r in box.states().collect()} == {"good": ("delivered", 1, None), "late": ("delivered", 2, None), "bad": ("dead", 3, "no")}
    assert [(r["message_id"], r["payload"]) for r in box.dead_letters().collect()] == [("bad", "c")]


def test_a_message_that_the_sink_does_not_name_keeps_its_lease(spark, tmp_path):
    box = Outbox(spark, f"file://{tmp_path}/o", lease=timedelta(seconds=60))
    box.put(spark.createDataFrame([("a", "x")], "message_id string, payload string"), T0)
    assert box.deliver(lambda df: df.select("message_id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error")).where("false"), T0).count() == 0
    assert [r["state"] for r in box.states().collect()] == ["leased"] and box.ready(T0 + timedelta(seconds=60)).count() == 1


def test_composed_text(spark):
    words = ["\u00e9", "e\u0301", "E\u0301", "plain", "", None, "o\u0302\u0301x a\u0323\u0302", "\u0301e", "\u0635\u0301", "\u1100\u1161", "e\u0302\u0323", "A\u030a", "\u212b"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for r in df.select("w", text.composed(F.col("w")).alias("c"), text.nfc(F.col("w")).alias("n")).collect():
        nfc = None if r["w"] is None else unicodedata.normalize("NFC", r["w"])
        assert r["n"] == nfc
        if r["w"] not in ("\u1100\u1161", "e\u0302\u0323", "\u212b"):  # not Latin with marks in order
            assert r["c"] == nfc
    assert len(text.latin_pairs()) > 400


def test_groups_do_not_see_how_marks_are_written(spark):
    rows = canonical(spark.createDataFrame([("Caf\u00e9", "a"), ("cafe\u0301", "a"), ("CAFE\u0301", "\u00c1"), ("cafe", "a\u0301")], "type string, source_computer string"))
    got = aggregate.aggregate(rows, aggregate.Definition(("type",), (aggregate.Measure("Count", "count"), aggregate.Measure("DistinctCount", "n", "source_computer")))).collect()
    assert sorted((r["count"], r["n"]) for r in got) == [(1, 1), (3, 2)]
