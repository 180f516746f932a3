"""Replay sessions: ordered history in portions, with state that outlives each of them.

A session evaluates one portion of rows after another. Its state, a machine for each (rule, group),
is a table of the store; what the session has done lies in a compare-and-set checkpoint:
the plan's hash, source and retention, the last event (time, record id, identity), the time up
to which coverage is final, and the folder of the state. State and findings are written
before the checkpoint moves, findings are known by their content, so a run that dies is run
again from the state before it.

A row that repeats the last event exactly is passed over. Any other row at or before it,
or before the final time, makes the session invalid: its findings would have been others. So
does a finding that is not certain (a row without its rule's group). An invalid session says so and
takes nothing more.

Portions are Spark jobs: matches and states meet by (rule, group), sorted, and stream
through the machines; neither a group nor the state of all groups is ever held whole, and
a group's own state is bounded (``max_held``).
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, replace
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.operators.detect import MAX_HELD, Machine, matches
from chronolith.operators.rules import Rule, Suppression, plan_hash
from chronolith.scratch import written
from chronolith.sources.store import Store

_OUT = "kind string, rule_id string, group_value string, status string, event_us long, evidence array<string>, machine binary"
_COLUMNS = ["kind", "rule_id", "group_value", "status", "event_us", "evidence", "machine"]


class InvalidReplay(ValueError):
    """The session's state does not stand for the history before this input."""


@dataclass(frozen=True)
class Position:
    """What a session has done."""

    plan: str
    source: str
    retention: str
    last_us: int | None = None
    last_record: int | None = None
    last_identity: str | None = None
    processed: int = 0
    final_us: int | None = None
    state: str | None = None
    portion: int = 0
    invalid: str | None = None
    complete: bool = False


def _fed(rules: dict[str, Rule], final_us: int | None, at_end: bool, most: int):
    """Streams states and events, sorted by group, through the machines; gives findings and the new states."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, machine = None, None

        def ended() -> list[tuple]:
            if machine is None:
                return []
            out = []
            if final_us is not None:
                out += [("finding", *key, status, at, e, None) for at, e, status in machine.due(final_us)]
            if at_end:
                out += [("finding", *key, status, at, e, None) for at, e, status in machine.due(None, lambda at: "Incomplete")]
            if machine.inner.size():
                out.append(("state", *key, None, None, None, pickle.dumps(machine)))
            return out

        for pdf in batches:
            out = []
            for rule_id, group, us, identity, steps, value, blob in zip(*(pdf[c].tolist() for c in ("rule_id", "group_value", "us", "identity", "steps", "distinct_value", "machine"))):
                if (rule_id, group) != key:
                    out += ended()
                    key, machine = (rule_id, group), pickle.loads(blob) if blob is not None else Machine(rules[rule_id], most)
                    if blob is not None:
                        continue
                found = machine.feed(int(us), identity, [int(s) for s in steps], value)
                out += [("finding", rule_id, group, "Incomplete" if status == "Full" else status, at, e, None) for at, e, status in found]
            if out:
                yield pd.DataFrame(out, columns=_COLUMNS).astype({"event_us": "Int64"})
        last = ended()
        if last:
            yield pd.DataFrame(last, columns=_COLUMNS).astype({"event_us": "Int64"})

    return run


class ReplaySession:
    """A named session of a store; the same name, rules, source and retention go on where it stopped."""

    def __init__(self, store: Store, name: str, rules: Sequence[Rule], source: str, retention: str, suppressions: Sequence[Suppression] = (), max_held: int = MAX_HELD):
        if not source or not retention:
            raise ValueError("a session names its source and its retention")
        self.store, self.name, self.rules, self.suppressions, self.max_held = store, f"replay/{name}", [r for r in rules if r.enabled], suppressions, max_held
        want = Position(plan_hash(rules, suppressions), source, retention)
        store.move_checkpoint(self.name, None, json.dumps(asdict(want), sort_keys=True))
        now = self.position()
        for part in ("plan", "source", "retention"):
            if getattr(now, part) != getattr(want, part):
                raise InvalidReplay(f"session {name!r} belongs to another {part}")

    def position(self) -> Position:
        return Position(**json.loads(self.store.checkpoint(self.name)))

    def _move(self, was: Position, now: Position) -> None:
        shown = [json.dumps(asdict(p), sort_keys=True) for p in (was, now)]
        if not self.store.move_checkpoint(self.name, *shown):
            raise InvalidReplay(f"session {self.name!r} was moved by another run")

    def _active(self) -> Position:
        now = self.position()
        if now.invalid:
            raise InvalidReplay(now.invalid)
        if now.complete:
            raise InvalidReplay("the session is complete")
        return now

    def _refuse(self, now: Position, why: str) -> None:
        self._move(now, replace(now, invalid=why))
        raise InvalidReplay(why)

    def process(self, rows: DataFrame) -> DataFrame:
        """Evaluates a portion of canonical rows, of whatever order inside it, and gives its findings, which are stored too."""
        now = self._active()
        us = F.unix_micros("time_created")
        place = F.struct(us.alias("us"), F.coalesce("record_id", F.lit(-(1 << 63))).alias("record"), F.coalesce("observation_identity", F.lit("")).alias("identity"))
        if now.last_us is not None:
            last = F.struct(F.lit(now.last_us).cast("long").alias("us"), F.lit(-(1 << 63) if now.last_record is None else now.last_record).cast("long").alias("record"), F.lit(now.last_identity).alias("identity"))
            rows = rows.where(place != last)  # the boundary, read again
            behind = F.count_if(place < last)
        else:
            behind = F.lit(0)
        early = F.count_if(us < now.final_us) if now.final_us is not None else F.lit(0)
        n, top, late, past = rows.agg(F.count(F.lit(1)), F.max(place), behind, early).first()
        if past:
            self._refuse(now, f"{past} rows predate the final coverage time")
        if late:
            self._refuse(now, f"{late} rows are older than the last event")
        if not n:
            return self._empty()
        hits = written(matches(rows, self.rules, self.suppressions), "replay-matches")
        record = None if top["record"] == -(1 << 63) else top["record"]
        return self._run(now, hits, replace(now, last_us=top["us"], last_record=record, last_identity=top["identity"], processed=now.processed + n), None, False)

    def advance(self, to: datetime) -> DataFrame:
        """Declares input before ``to`` complete: absences due by then are found; later evidence from before it invalidates the session."""
        now = self._active()
        final = int(to.replace(tzinfo=to.tzinfo or timezone.utc).timestamp() * 1e6)
        if now.final_us is not None and final < now.final_us:
            raise ValueError("the final time cannot move back")
        return self._run(now, None, replace(now, final_us=final), final, False)

    def complete(self) -> DataFrame:
        """Ends the session: what absence rules still wait for becomes Incomplete."""
        now = self._active()
        return self._run(now, None, replace(now, complete=True), now.final_us, True)

    def state(self) -> DataFrame | None:
        """(rule_id, group_value, us, machine): the state between portions."""
        folder = self.position().state
        return self.store.spark.read.parquet(f"{self.store.path}/{folder}") if folder else None

    def _empty(self) -> DataFrame:
        return self.store.spark.createDataFrame([], "rule_id string, group_value string, status string, event_time timestamp, evidence array<string>")

    def _run(self, now: Position, hits: DataFrame | None, then: Position, final_us: int | None, at_end: bool) -> DataFrame:
        spark, columns = self.store.spark, ["rule_id", "group_value", "status", "event_time", "evidence"]
        by_id = {r.rule_id: r for r in self.rules}
        plain = [r.rule_id for r in self.rules if r.kind == "Stateless"]
        held = spark.read.parquet(f"{self.store.path}/{now.state}") if now.state else None
        parts, streams = [], []
        if held is not None:
            streams.append(held.select("rule_id", "group_value", F.lit(None).cast("long").alias("us"), F.lit(None).cast("long").alias("record_id"), F.lit(None).cast("string").alias("identity"), F.lit(None).cast("array<int>").alias("steps"), F.lit(None).cast("string").alias("distinct_value"), "machine"))
        if hits is not None:
            if plain:
                parts.append(hits.where(F.col("rule_id").isin(plain)).select("rule_id", "group_value", F.lit("Matched").alias("status"), F.col("time_created").alias("event_time"), F.array("identity").alias("evidence")))
            stateful = hits if not plain else hits.where(~F.col("rule_id").isin(plain))
            lacking = stateful.where("missing IS NOT NULL").groupBy("rule_id", "missing").agg(F.min("time_created").alias("event_time"))
            parts.append(lacking.select("rule_id", F.lit(None).cast("string").alias("group_value"), F.lit("Incomplete").alias("status"), "event_time", F.array().cast("array<string>").alias("evidence")))
            streams.append(stateful.where("missing IS NULL").select("rule_id", "group_value", F.unix_micros("time_created").alias("us"), "record_id", "identity", "steps", "distinct_value", F.lit(None).cast("binary").alias("machine")))
        folder = None
        if streams:
            every = streams[0] if len(streams) == 1 else streams[0].unionByName(streams[1])
            in_order = (F.col("rule_id"), F.col("group_value"), F.col("machine").isNull(), F.col("us"), F.col("record_id").asc_nulls_first(), F.col("identity"))  # a group's state comes first
            fed = every.repartition("rule_id", "group_value").sortWithinPartitions(*in_order)
            out = fed.select("rule_id", "group_value", "us", "identity", "steps", "distinct_value", "machine").mapInPandas(_fed(by_id, final_us, at_end, self.max_held), _OUT)
            out = written(out, "replay-out")
            folder = f"{self.name}/state-{then.portion + 1}"
            out.where("kind = 'state'").select("rule_id", "group_value", "machine").write.mode("overwrite").parquet(f"{self.store.path}/{folder}")
            parts.append(out.where("kind = 'finding'").select("rule_id", "group_value", "status", F.timestamp_micros("event_us").alias("event_time"), "evidence"))
        found = self._empty()
        for p in parts:
            found = found.unionByName(p.select(*columns))
        found = written(found, "replay-findings")
        self.store.write_findings(found)
        uncertain = None if at_end or found.where("status <> 'Matched'").isEmpty() else "a finding is incomplete"
        self._move(now, replace(then, state=folder or now.state, portion=now.portion + 1, invalid=uncertain))
        return found
