"""A durable outbox: messages that wait, are leased, come again after a failure, and are delivered or buried once.

What happened to messages is a log that only grows, a table of (message_id, seq, state, ready_at,
attempts, error); a message's state is its last row. A delivery run takes the messages
whose time has come, writes their leases, hands them over, and writes the outcomes. A run
that dies leaves leases; when these end, the messages are ready again. So a message is never lost,
and it is handed over again only if its run died in between or its delivery failed.

One run at a time owns the outbox: ``seq`` comes from the state that it read, and of two
rows of one seq the later outcome (delivered, then dead) counts.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.scratch import written

#: In order of weight.
STATES = ("pending", "leased", "dead", "delivered")
_LOG = "message_id string, seq long, state string, ready_at timestamp, attempts int, error string"
_OUTCOME = "message_id, ok and error (null if ok)"


def _utc(at: datetime) -> datetime:
    return at.replace(tzinfo=at.tzinfo or timezone.utc)


class Outbox:
    """A folder with the tables messages (message_id, payload) and log."""

    def __init__(self, spark: SparkSession, path: str, attempts: int = 5, backoff: timedelta = timedelta(seconds=30), lease: timedelta = timedelta(minutes=5)):
        if attempts < 1:
            raise ValueError("a message is handed over at least once")
        self.spark, self.path, self.attempts, self.backoff, self.lease = spark, path.rstrip("/"), attempts, backoff, lease

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def messages(self) -> DataFrame:
        return self._table("messages", "message_id string, payload string")

    def put(self, messages: DataFrame, at: datetime) -> None:
        """Adds messages (message_id, payload) that the outbox has not; they are ready from ``at`` on."""
        fresh = messages.select("message_id", "payload").where("message_id IS NOT NULL").dropDuplicates(["message_id"])
        fresh = written(fresh.join(self.messages().select("message_id"), "message_id", "left_anti"), "outbox-fresh")
        self._note(fresh.select("message_id", F.lit(1).cast("long").alias("seq"), F.lit("pending").alias("state"), F.lit(_utc(at)).alias("ready_at"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error")))
        fresh.write.mode("append").parquet(f"{self.path}/messages")  # last: a message without it is put again, its first row being the same

    def _note(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/log")

    def states(self) -> DataFrame:
        """The last log row of each message."""
        weight = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
        last = F.max(F.struct("seq", weight.alias("weight"), "state", "ready_at", "attempts", "error")).alias("last")
        return self._table("log", _LOG).groupBy("message_id").agg(last).select("message_id", "last.seq", "last.state", "last.ready_at", "last.attempts", "last.error")

    def ready(self, now: datetime) -> DataFrame:
        """(message_id, payload, seq, attempts) of messages whose time has come, leases that ended among them."""
        due = self.states().where(F.col("state").isin("pending", "leased") & (F.col("ready_at") <= F.lit(_utc(now))))
        return due.join(self.messages(), "message_id").select("message_id", "payload", "seq", "attempts")

    def deliver(self, hand_over: Callable[[DataFrame], DataFrame], now: datetime) -> DataFrame:
        """Hands the ready messages (message_id, payload, attempts) over; ``hand_over`` returns (message_id, ok, error).

        A message that failed is ready again after the backoff, doubled with each try, and dead after the
        last. One that ``hand_over`` says nothing of keeps its lease. If ``hand_over`` raises, all leases stay.
        """
        taken = written(self.ready(now), "outbox-taken")
        until, tries = F.lit(_utc(now + self.lease)), F.col("attempts") + 1
        self._note(taken.select("message_id", (F.col("seq") + 1).alias("seq"), F.lit("leased").alias("state"), until.alias("ready_at"), "attempts", F.lit(None).cast("string").alias("error")))
        said = hand_over(taken.select("message_id", "payload", "attempts")).select("message_id", "ok", "error").dropDuplicates(["message_id"])
        wait = F.lit(self.backoff.total_seconds()) * F.pow(F.lit(2), F.col("attempts"))
        again = F.timestamp_micros((F.lit(int(_utc(now).timestamp() * 1e6)) + wait * 1e6).cast("long"))
        state = F.when(F.col("ok"), "delivered").when(tries >= self.attempts, "dead").otherwise("pending")
        met = taken.join(said, "message_id").withColumn("state", state)
        outcome = met.select("message_id", (F.col("seq") + 2).alias("seq"), "state", F.when(F.col("state") == "pending", again).otherwise(F.lit(_utc(now))).alias("ready_at"), tries.cast("int").alias("attempts"), F.when(~F.col("ok"), F.coalesce(F.substring("error", 1, 1000), F.lit("failed"))).alias("error"))
        outcome = written(outcome, "outbox-outcome")  # a sink is asked once
        self._note(outcome)
        return outcome

    def dead_letters(self) -> DataFrame:
        return self.states().where("state = 'dead'").join(self.messages(), "message_id")
