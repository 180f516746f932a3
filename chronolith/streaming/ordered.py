"""Stateful rules over a stream that comes out of order: a reorder buffer for each group.

The watermark is the greatest event time of the batches before, less the reorder window.
Each (rule, group) keeps the events at or behind it that came since, beside its machine and timer, in one value; what lies
strictly before the watermark is fed to the rule's state machine in order of (time, record
id, identity), and timers do the same for groups that get no more events. So a stream whose disorder
stays inside the window gives the findings of the batch detector, and a heartbeat far
ahead drains the buffers at the end.

An event older than the watermark is late. It is not evaluated; it comes out as an
Incomplete row with its identity, or fails the stream, as told. The same goes for events beyond the
buffer's or the state's bound. Spark drops late rows itself before a stateful operator if it sees
their event time, so the time goes in as a number. State lies in RocksDB and moves
with Spark's own checkpoint: a batch that runs again starts from the same state.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from chronolith.operators.detect import MAX_HELD, Machine, matches
from chronolith.operators.rules import Rule
from chronolith.schema import CANONICAL

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FOUND = "rule_id string, group_value string, status string, event_us long, evidence array<string>, note string"
_COLUMNS = ["rule_id", "group_value", "status", "event_us", "evidence", "note"]


def _order(e: tuple) -> tuple:
    return e[0], e[1] is not None, e[1] or 0, e[2]


class ReorderedRule(StatefulProcessor):
    """The reorder buffer and the state machine of one rule's groups."""

    def __init__(self, rule: Rule, late: str, max_buffered: int, max_held: int):
        self.rule, self.late, self.max_buffered, self.max_held = rule, late, max_buffered, max_held
        self.window = int(rule.window_seconds * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "held binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        (held, machine, timer), out = self._state(), []
        for pdf in rows:
            for us, record_id, identity, steps, value in zip(*(pdf[c].tolist() for c in ("us", "record_id", "identity", "steps", "distinct_value"))):
                record_id = None if record_id is None else int(record_id)
                if us < watermark:
                    if self.late == "fail":
                        raise ValueError(f"event {identity!r} of rule {self.rule.rule_id!r} is behind the watermark")
                    out.append((us, [identity], "Incomplete", "late"))
                elif len(held) >= self.max_buffered:
                    out.append((us, [identity], "Incomplete", "buffer"))
                else:
                    held.append((us, record_id, identity, [int(s) for s in steps], value))
        yield from self._shown(key, out + self._drained(held, machine, timer, watermark))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, machine, _ = self._state()
        yield from self._shown(key, self._drained(held, machine, None, timerValues.getCurrentWatermarkInMs() * 1000))  # Spark deletes a timer that has expired

    def close(self) -> None:
        pass

    def _state(self) -> tuple[list[tuple], Machine | None, int | None]:
        """The buffered events, the machine and the timer. One value, since each look at the state is a call to the JVM."""
        found = self.state.get()
        return pickle.loads(found[0]) if found is not None else ([], None, None)

    def _drained(self, held: list[tuple], machine: Machine | None, timer: int | None, watermark: int) -> list[tuple]:
        """Feeds what the watermark has passed, keeps the rest, and sets the time to look again."""
        held.sort(key=_order)
        machine = machine or Machine(self.rule, self.max_held)
        ready = sum(e[0] < watermark for e in held)
        out = []
        for us, _, identity, steps, value in held[:ready]:
            out += machine.feed(us, identity, steps, value)
        out = [(at, evidence, "Incomplete", "state") if status == "Full" else (at, evidence, status, None) for at, evidence, status in out + machine.due(watermark)]
        rest = held[ready:]
        looks = [rest[0][0]] if rest else []
        if machine.absence and machine.inner.open:
            looks.append(machine.inner.open[0][0] + self.window)
        elif not machine.absence and machine.last + self.window >= watermark and machine.inner.size():
            looks.append(machine.last + self.window)
        look = max(min(looks), watermark) // 1000 + 1 if looks else None
        if timer is not None and timer != look:
            self.handle.deleteTimer(timer)
        if look is not None:
            self.state.update((pickle.dumps((rest, machine, look)),))
            if timer != look:
                self.handle.registerTimer(look)
        else:
            self.state.clear()  # nothing that could still be part of a finding
        return out

    def _shown(self, key, found: list[tuple]) -> Iterator[pd.DataFrame]:
        if found:
            yield pd.DataFrame([(*key, status, at, evidence, note) for at, evidence, status, note in found], columns=_COLUMNS)


def watermarked(rows: DataFrame, window: str) -> DataFrame:
    """``rows`` with a watermark that every row moves, also those that later filters drop.

    Spark would push such filters below the watermark, which then stood still while no row
    of interest came. They do not pass an expression that is not deterministic (of a single rand() Spark knows the range).
    """
    return rows.withWatermark("time_created", window).withColumn("time_created", F.when(F.rand(0) + F.rand(1) >= 0, F.col("time_created")))


def reordered_findings(rows: DataFrame, rule: Rule, window: str = "10 minutes", late: str = "report", max_buffered: int = 100_000, max_held: int = MAX_HELD) -> DataFrame:
    """(rule_id, group_value, status, event_us, evidence, note) of a stateful rule over a stream in disorder up to ``window``.

    ``late`` is report or fail. Of note: late, buffer (the group's reorder buffer is full) or state
    (its state is full) for Incomplete rows, null for findings. The session must keep state in RocksDB
    (``use_rocksdb``).
    """
    if late not in ("report", "fail"):
        raise ValueError(f"late is report or fail, not {late!r}")
    rule.check()
    if rule.kind == "Stateless":
        raise ValueError("a stateless rule needs no order")
    hits = matches(watermarked(rows, window).where("observation_identity IS NOT NULL"), [rule]).where("missing IS NULL")  # a heartbeat has no identity
    number = F.col("record_id").cast("string").alias("record_id")  # pandas would make floats of whole numbers beside nulls
    timed = hits.select("rule_id", "group_value", F.unix_micros("time_created").alias("us"), number, "identity", "steps", "distinct_value")
    return timed.groupBy("rule_id", "group_value").transformWithStateInPandas(ReorderedRule(rule, late, max_buffered, max_held), FOUND, "Append", "EventTime")


def use_rocksdb(spark: SparkSession) -> None:
    """State that timers need; for sessions that a cluster has not set up so."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def heartbeat(spark: SparkSession, at) -> DataFrame:
    """A canonical row that no rule takes; fed to a stream, it moves the watermark to ``at`` less the window."""
    return spark.createDataFrame([tuple(at if f.name == "time_created" else None for f in CANONICAL.fields)], CANONICAL)
