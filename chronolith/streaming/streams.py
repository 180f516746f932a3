"""Structured Streaming forms: ingestion into the store, deduplication, windows, stateful rules.

Spark's watermark is global and moves once a micro-batch; a row on the watermark itself is
kept here and rows strictly older are late. Batch replay (``operators.detect``) is the exact
form; a stream fed in order of time gives the same findings.
"""

from __future__ import annotations

import pickle
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronolith.functions.times import calendar_start
from chronolith.operators.detect import MACHINES, Absence, matches
from chronolith.operators.rules import Rule, plan_hash
from chronolith.sources.store import Store


def delivered_once(rows: DataFrame, key: str = "observation_identity", delay: str = "10 minutes") -> DataFrame:
    """Rows whose identity has not come within the watermark."""
    return rows.withWatermark("time_created", delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(rows: DataFrame, length: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events by type and tumbling window, final once the watermark passes."""
    return rows.withWatermark("time_created", delay).groupBy(F.window("time_created", length), "type").agg(F.count(F.lit(1)).alias("count")).select(F.col("window.start").alias("bucket"), "type", "count")


def daily_counts(rows: DataFrame) -> DataFrame:
    """A running total by day and type, for complete or update mode."""
    return rows.groupBy(calendar_start(F.col("time_created"), "Day").alias("day"), "type").agg(F.count(F.lit(1)).alias("count"))


def ingest(rows: DataFrame, store: Store, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes a stream to the store; a batch that is run again adds nothing."""
    return rows.writeStream.foreachBatch(lambda df, _: store.write(df)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def outbox(rows: DataFrame, deliver: Callable[[DataFrame, int], None], path: str, checkpoint: str, attempts: int = 3, **trigger) -> StreamingQuery:
    """Hands each batch to ``deliver``; one that fails ``attempts`` times is kept as a dead letter under ``path``."""

    def send(df: DataFrame, batch: int) -> None:
        held = df.persist()
        try:
            for attempt in range(attempts):
                try:
                    return deliver(held, batch)
                except Exception as e:  # noqa: BLE001 what a sink raises is not known here
                    if attempt == attempts - 1:
                        held.withColumn("error", F.lit(str(e)[:1000])).write.mode("overwrite").parquet(f"{path}/batch={batch}")
        finally:
            held.unpersist()

    return rows.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(**trigger).start()


_FINDING = "rule_id string, group_value string, event_us long, evidence array<string>"


def rule_findings(rows: DataFrame, rule: Rule, delay: str = "10 minutes") -> DataFrame:
    """Findings of a stateful rule over a stream: the batch detector's state machine is the state of each group.

    A group's state leaves when its window has passed without events. The triggers of an
    absence rule fire when the watermark passes their deadline.
    """
    window, absence = int(rule.window_seconds * 1e6), rule.kind == "Absence"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last = (pickle.loads(state.get[0]), state.get[1]) if state.exists else (Absence(rule) if absence else MACHINES[rule.kind](rule), 0)
        found = []
        if state.hasTimedOut:
            found += [(at, [i]) for at, i in held.due(state.getCurrentWatermarkMs() * 1000)] if absence else []
        else:
            events = sorted((us, i, tuple(s), v) for pdf in batches for us, i, s, v in zip(pdf["us"].tolist(), pdf["identity"].tolist(), pdf["steps"], pdf["distinct_value"].tolist()))
            for us, identity, steps, value in events:
                if absence:
                    found += [(at, [i]) for at, i in held.feed(us, identity, steps)]
                elif (evidence := held.feed(us, identity, steps, value)) is not None:
                    found.append((us, evidence))
                last = max(last, us)
        due = held.open[0][0] + window if absence and held.open else last + window if not absence and not state.hasTimedOut else None
        if due is None:
            state.remove()
        else:
            state.update((pickle.dumps(held), last))
            state.setTimeoutTimestamp(max(due // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if found:
            yield pd.DataFrame([(key[0], key[1], at, evidence) for at, evidence in found], columns=["rule_id", "group_value", "event_us", "evidence"])

    hits = matches(rows.withWatermark("time_created", delay), [rule]).where("missing IS NULL").withColumn("us", F.unix_micros("time_created"))
    return hits.groupBy("rule_id", "group_value").applyInPandasWithState(step, _FINDING, "machine binary, last long", "append", GroupStateTimeout.EventTimeTimeout)


def lacking(rows: DataFrame, rule: Rule, delay: str = "10 minutes") -> DataFrame:
    """(rule_id, status, field, event_time): one Incomplete finding for each field that rows of a rule lack, within the watermark."""
    hits = matches(rows.withWatermark("time_created", delay), [rule]).where("missing IS NOT NULL")
    once = hits.select("rule_id", F.lit("Incomplete").alias("status"), F.col("missing").alias("field"), "time_created").dropDuplicatesWithinWatermark(["rule_id", "field"])
    return once.withColumnRenamed("time_created", "event_time")


def split_late(rows: DataFrame, watermark: datetime) -> DataFrame:
    """``rows`` with late: whether a row is older than a watermark (one on it is in time). Nothing is dropped."""
    return rows.withColumn("late", F.coalesce(F.col("time_created") < F.lit(watermark), F.lit(False)))


def reporting_late(rows: DataFrame, handle: Callable[[DataFrame, int], None], late: Callable[[DataFrame, int], None] | None, allowed: timedelta, store: Store, name: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Hands each batch's rows to ``handle`` and late ones to ``late``; without ``late`` a late row fails the stream.

    Late is what is older than the newest time of the batches before, less ``allowed``; that
    time is the store's checkpoint ``name``, so a restarted stream judges alike. A batch that dies
    before the checkpoint moves is handed over again, whole; one that dies after it is not.
    """

    def step(df: DataFrame, batch: int) -> None:
        held = df.persist()
        try:
            now = store.checkpoint(name)
            done, newest = (int(x) if x else None for x in (now or ",").split(","))
            if done is not None and done >= batch:  # it was done before a crash kept Spark from noting so: handling it twice would be wrong
                return
            if newest is None:
                handle(held, batch)
            else:
                marked = split_late(held, datetime.fromtimestamp(newest / 1e6, timezone.utc) - allowed)
                behind = marked.where("late").drop("late")
                if late is None and not behind.isEmpty():
                    raise ValueError(f"batch {batch} of {name!r} has rows behind the watermark")
                if late is not None:
                    late(behind, batch)
                handle(marked.where("NOT late").drop("late"), batch)
            top = held.agg(F.max(F.unix_micros("time_created"))).first()[0]
            last = max((x for x in (top, newest) if x is not None), default=None)
            if last is not None and not store.move_checkpoint(name, now, f"{batch},{last}"):
                raise ValueError(f"checkpoint {name!r} was moved by another stream")
        finally:
            held.unpersist()

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def replay(rows: DataFrame, rule: Rule, store: Store, name: str, checkpoint: str, delay: str = "10 minutes", **trigger) -> StreamingQuery:
    """Feeds a stream to a rule and its findings to the store; it goes on from its checkpoint as long as the rule is the same.

    The store's checkpoint ``name`` holds the plan's hash. State made by another plan would
    give findings of neither, so a changed rule is an error until a new name is taken.
    """
    bound = plan_hash([rule])
    if not store.move_checkpoint(name, None, bound) and store.checkpoint(name) != bound:
        raise ValueError(f"checkpoint {name!r} belongs to another plan")
    found = rule_findings(rows, rule, delay).select("rule_id", "group_value", F.lit("Matched").alias("status"), F.timestamp_micros("event_us").alias("event_time"), "evidence")
    return found.writeStream.foreachBatch(lambda df, _: store.write_findings(df)).option("checkpointLocation", f"{checkpoint}/{bound[:16]}").trigger(**trigger).start()


def first_matches(rows: DataFrame, path: str, checkpoint: str, most: int | None = None, **trigger) -> StreamingQuery:
    """Writes the rows of a stream under ``path``, a folder a micro-batch, and no more than ``most`` in all.

    Of the micro-batch that reaches ``most`` the earliest rows are taken, so one batch holds
    at most that many. A folder counts once Spark has marked it as finished: a batch that died before is
    written again, one that runs again after it is passed over, and what earlier batches wrote is
    counted from their files. So restarts, or a stop at any time, neither lose nor repeat a row.
    """

    def deliver(df: DataFrame, batch: int) -> None:
        spark, at = df.sparkSession, f"{path}/batch={batch}"
        if _matching(spark, f"{at}/_SUCCESS"):
            return
        if most is not None:
            room = most - taken(spark, path, batch)
            if room <= 0:
                return
            df = df.orderBy("time_created", "record_id").limit(room)
        df.write.mode("overwrite").parquet(at)

    return rows.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _matching(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a pattern."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return [f.getPath().toString() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []]


def taken(spark: SparkSession, path: str, before: int | None = None) -> int:
    """How many rows stand under ``path`` in finished batches: those before one, or all."""
    done = [f.removesuffix("/_SUCCESS") for f in _matching(spark, f"{path}/batch=*/_SUCCESS")]
    done = [f for f in done if before is None or int(f.rpartition("batch=")[2]) < before]
    return spark.read.parquet(*done).count() if done else 0


@dataclass
class _Watch:
    query: StreamingQuery
    deadline: float | None
    enough: Callable[[], bool] | None
    reason: str = "running"
    thread: threading.Thread | None = None


class Watchers:
    """Named streaming queries that are started, listed and stopped together, or that stop by themselves.

    A watcher ends after ``timeout`` seconds, once ``enough()`` is true, when its source
    ends, by failure, or by ``stop``; ``reasons`` says which. Starting one that runs is an
    error, whatever its settings.
    """

    #: Seconds between two looks at a watcher.
    EVERY = 0.5

    def __init__(self):
        self.running: dict[str, StreamingQuery] = {}
        self._watches: dict[str, _Watch] = {}

    def start(self, name: str, begin: Callable[[], StreamingQuery], timeout: float | None = None, enough: Callable[[], bool] | None = None) -> StreamingQuery:
        if timeout is not None and timeout <= 0:
            raise ValueError("a timeout must be positive")
        if name in self.running and self.running[name].isActive:
            raise ValueError(f"a watcher {name!r} is running")
        query = begin()
        watch = _Watch(query, None if timeout is None else time.monotonic() + timeout, enough)
        self.running[name], self._watches[name] = query, watch
        watch.thread = threading.Thread(target=self._follow, args=(watch,), daemon=True)
        watch.thread.start()
        return query

    def _follow(self, watch: _Watch) -> None:
        try:
            while not watch.query.awaitTermination(self.EVERY):
                due = watch.deadline is not None and time.monotonic() >= watch.deadline
                if due or watch.enough is not None and watch.enough():
                    watch.reason = "timeout" if due else "enough"
                    watch.query.stop()
                    return
            if watch.reason == "running":
                watch.reason = "ended"
        except Exception as e:  # noqa: BLE001 - a watcher's failure is its result
            if watch.reason == "running":
                watch.reason = f"failed: {str(e).splitlines()[0] if str(e) else type(e).__name__}"
                watch.query.stop()

    def states(self) -> dict[str, bool]:
        return {n: q.isActive for n, q in self.running.items()}

    def reasons(self) -> dict[str, str]:
        """What each watcher does, or why it ended; stopped ones too."""
        return {n: w.reason for n, w in self._watches.items()}

    def find(self, query_id: str) -> list[str]:
        """The names of watchers whose query has this id."""
        return [n for n, q in self.running.items() if q.id == query_id]

    def wait(self) -> dict[str, str]:
        """Waits until no watcher runs, and says why each ended."""
        for w in list(self._watches.values()):
            w.thread.join()
        return self.reasons()

    def stop(self, name: str | None = None, query_id: str | None = None) -> None:
        """Stops one watcher by name or by its query's id, or all."""
        names = [name] if name else self.find(query_id) if query_id else list(self.running)
        for n in names:
            watch = self._watches[n]
            if watch.reason == "running" and watch.query.isActive:
                watch.reason = "stopped"
            self.running.pop(n).stop()
            watch.thread.join()
