"""The history store: Parquet tables by day, written once, read with pushed-down filters.

A row's key is the hash of what identifies it, so writing the same rows again adds
nothing. Checkpoints are files, a version each, and move by compare-and-set.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence
from datetime import datetime
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.operators import detect
from chronolith.operators.predicates import Predicate, compile_predicate
from chronolith.operators.rules import Rule, Suppression
from chronolith.scratch import written

_IDENTITY = ["type", "source_computer", "source_log", "provider", "event_id", "record_id", "time_created", "message"]


def event_key() -> Column:
    """What makes two rows the same; payload maps count by their sorted entries."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in _IDENTITY]
    return F.sha2(F.to_json(F.struct(F.array(*parts).alias("c"), F.array_sort(F.map_entries("values")).alias("v"))), 256)


#: Partitions of the entity table.
ENTITY_BUCKETS = 64


def entity_bucket(value_key: Column) -> Column:
    return F.pmod(F.xxhash64(value_key), F.lit(ENTITY_BUCKETS)).cast("int")


class Store:
    """A folder with events, findings and checkpoints."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):  # none yet, or all pruned
                return None
            raise

    def write(self, rows: DataFrame) -> None:
        """Adds rows that the store has not, for one writer at a time. Only the days that come are read for comparison.

        ``type_key``, the type in capitals, is stored for filters without case.
        """
        self._mend()
        rows = rows.withColumn("type_key", F.upper("type"))
        made = rows.withColumn("event_key", event_key()).dropDuplicates(["event_key"]).withColumn("day", F.to_date("time_created"))
        had = self._table("events")
        if had is not None:
            known = had.select("event_key", "day").join(rows.select(F.to_date("time_created").alias("day")).distinct(), "day", "left_semi").select("event_key")
            made = made.join(known, "event_key", "left_anti")
        made.write.mode("append").partitionBy("day").parquet(f"{self.path}/events")

    def read(self, predicate: Predicate | None = None, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        """Stored rows; a time range prunes days before anything is read."""
        self._mend()
        rows = self._table("events")
        if rows is None:
            raise ValueError("the store has no events")
        if start is not None:
            rows = rows.where((F.col("day") >= F.lit(start.date())) & (F.col("time_created") >= F.lit(start)))
        if end is not None:
            rows = rows.where((F.col("day") <= F.lit(end.date())) & (F.col("time_created") <= F.lit(end)))
        return rows if predicate is None else rows.where(compile_predicate(predicate, rows))

    def newest(self, limit: int, predicate: Predicate | None = None, **span: datetime) -> DataFrame:
        """The last rows in stored order: time, record id, key."""
        return self.read(predicate, **span).orderBy(F.col("time_created").desc(), F.col("record_id").desc_nulls_last(), F.col("event_key").desc()).limit(limit)

    def prune(self, before: datetime, types: list[str] | None = None) -> None:
        """Forgets rows before a time, of all types or some.

        The rows that stay are written first, beside the day they come from, and a day is then
        swapped by two renames. A run that dies in between is finished by the next ``prune``,
        ``write`` or ``read``: at every moment a day lies whole in one of the two places.
        """
        self._mend()
        rows = self._table("events")
        if rows is None:
            return
        gone = F.col("time_created") < F.lit(before)
        if types is not None:
            gone = gone & F.upper("type").isin([t.upper() for t in types])
        days = [r["day"] for r in rows.where(F.col("day") <= F.lit(before.date())).where(gone).select("day").distinct().collect()]
        if not days:
            return
        staged = f"{self.path}/_staged-{uuid.uuid4().hex}"
        rows.where(F.col("day").isin(days)).where(~F.coalesce(gone, F.lit(False))).write.partitionBy("day").parquet(staged)
        fs, path = self._files()
        swap = path(f"{self.path}/swap.txt")
        out = fs.create(path(f"{self.path}/swap.new"), True)
        out.write(bytearray("\n".join([staged.rpartition("/")[2], *map(str, days)]).encode()))
        out.close()
        fs.rename(path(f"{self.path}/swap.new"), swap)  # from here on the swap is decided
        self._mend()

    def _files(self):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.path).getFileSystem(conf), path

    def _mend(self) -> None:
        """Finishes a decided swap of days; a staged folder that no swap names was never decided and stays unread."""
        fs, path = self._files()
        swap = path(f"{self.path}/swap.txt")
        if not fs.exists(swap):
            return
        staged, *days = [r["value"] for r in self.spark.read.text(f"{self.path}/swap.txt").collect()]  # a line a day
        for day in days:
            made, place, old = path(f"{self.path}/{staged}/day={day}"), path(f"{self.path}/events/day={day}"), path(f"{self.path}/{staged}/_old-{day}")
            if fs.exists(place) and not fs.exists(old):
                fs.rename(place, old)
            if fs.exists(made) and not fs.exists(place):
                fs.rename(made, place)
        fs.delete(swap, False)
        fs.delete(path(f"{self.path}/{staged}"), True)

    def detect(self, rules: Sequence[Rule], suppressions: Sequence[Suppression] = (), start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        """Findings over stored rows; the ids or types that the rules allow, and the days, are filters of the scan."""
        rows = self.read(start=start, end=end)
        known = rows.withColumn("observation_identity", F.coalesce("observation_identity", "event_key"))
        return detect.evaluate(known.where(detect.prefilter(known, rules)), rules, suppressions, end)

    def define(self, name: str, fields: dict[str, str]) -> dict[str, str]:
        """Merges a definition's fields (name to Spark type) into those stored under its name; a changed type is an error.

        Field names go without case. Each version is a row with its hash; the same fields add none.
        """
        now = self.definition(name)
        had = {k.lower(): t for k, t in now.items()}
        clash = [k for k, t in fields.items() if had.get(k.lower(), t) != t]
        if clash:
            raise ValueError(f"definition {name!r}: other types for {clash}")
        merged = {**now, **{k: t for k, t in fields.items() if k.lower() not in had}}
        if merged != now:
            shown = json.dumps(merged, sort_keys=True)
            row = (name, len(merged), shown, hashlib.sha256(shown.encode()).hexdigest())
            self.spark.createDataFrame([row], "name string, version int, fields string, hash string").coalesce(1).write.mode("append").parquet(f"{self.path}/definitions")
        return merged

    def definition(self, name: str) -> dict[str, str]:
        """The fields stored under a name; none if it is unknown. Fields are only added, so the version with most is the last."""
        rows = self._table("definitions")
        last = None if rows is None else rows.where(F.lower("name") == name.lower()).orderBy(F.col("version").desc()).first()
        return json.loads(last["fields"]) if last else {}

    def write_findings(self, findings: DataFrame) -> None:
        """Adds findings; one is known by its rule, group, time and evidence. Their ``entities`` (kind, value), where they
        have that column, also go to a table of their own, dealt by the value without case."""
        key = F.sha2(F.to_json(F.struct("rule_id", "group_value", "status", "event_time", "evidence")), 256)
        made = findings.withColumn("finding_key", key).dropDuplicates(["finding_key"])
        had = self._table("findings")
        if had is not None:
            made = made.join(had.select("finding_key"), "finding_key", "left_anti")
        if "entities" in findings.columns:
            made = written(made, "findings")  # two tables come of it
            each = made.select("finding_key", F.explode("entities").alias("e")).select("finding_key", "e.kind", "e.value").where("value IS NOT NULL")
            dealt = each.withColumn("value_key", F.upper("value")).withColumn("bucket", entity_bucket(F.col("value_key")))
            # entities first: a run that dies in between leaves some that name no finding yet, and is made good by the next
            dealt.distinct().repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/finding_entities")
        made.write.mode("append").parquet(f"{self.path}/findings")

    def findings(self, entity: str | None = None) -> DataFrame:
        """Stored findings, or those whose evidence has an identity."""
        rows = self._table("findings")
        return rows if entity is None else rows.where(F.array_contains("evidence", entity))

    def findings_about(self, value: str, kind: str | None = None) -> DataFrame:
        """Stored findings with an entity, an account or a computer say, without case; of the entity table one bucket is read."""
        rows, table = self._table("findings"), self._table("finding_entities")
        if rows is None or table is None:
            raise ValueError("the store has no findings with entities")
        bucket = self.spark.range(1).select(entity_bucket(F.upper(F.lit(value)))).first()[0]
        hit = table.where((F.col("bucket") == bucket) & (F.col("value_key") == F.upper(F.lit(value))))
        if kind is not None:
            hit = hit.where(F.lower("kind") == kind.lower())
        return rows.join(hit.select("finding_key"), "finding_key", "left_semi")

    def _checkpoint(self, name: str) -> tuple[int, str | None]:
        """(version, position) of a checkpoint, from the last of its files; version 0 if there is none."""
        fs, path = self._files()
        folder = path(f"{self.path}/checkpoints/name={quote(name, safe='')}")
        if not fs.exists(folder):
            return 0, None
        last = max((int(f.getPath().getName()[1:-5]) for f in fs.listStatus(folder) if f.getPath().getName().startswith("v")), default=0)
        if not last:
            return 0, None
        return last, json.loads(self.spark.read.text(f"{folder.toString()}/v{last}.json", wholetext=True).first()["value"])["position"]

    def checkpoint(self, name: str) -> str | None:
        return self._checkpoint(name)[1]

    def move_checkpoint(self, name: str, expected: str | None, position: str) -> bool:
        """Moves a checkpoint from ``expected``; False if it is elsewhere by now.

        Each version is a file that only one writer can create, so of two that saw the same
        version one wins; that needs a file system whose create without overwriting is atomic.
        """
        version, now = self._checkpoint(name)
        if now != expected:
            return False
        fs, path = self._files()
        target = path(f"{self.path}/checkpoints/name={quote(name, safe='')}/v{version + 1}.json")
        try:
            out = fs.create(target, False)
        except Py4JJavaError as e:
            if "already exists" in str(e.java_exception):
                return False
            raise
        out.write(bytearray(json.dumps({"name": name, "version": version + 1, "position": position}).encode()))
        out.close()
        return True

    def _checkpoints(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("name string, version long, position string").option("recursiveFileLookup", True).json(f"{self.path}/checkpoints")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def backup(self, target: str) -> dict[str, str]:
        """Copies every table and returns each one's count and hash."""
        self._mend()
        out = {}
        for name in ("events", "findings", "finding_entities", "definitions"):
            rows, dealt = self._table(name), {"events": "day", "finding_entities": "bucket"}.get(name)
            if rows is not None:
                (rows.write.partitionBy(dealt) if dealt else rows.write).mode("overwrite").parquet(f"{target}/{name}")
                out[name] = digest(rows)
        moved = self._checkpoints()
        if moved is not None:
            copy = Store(self.spark, target)
            for r in moved.groupBy("name").agg(F.max_by("position", "version").alias("position")).collect():  # a row a checkpoint
                copy.move_checkpoint(r["name"], copy.checkpoint(r["name"]), r["position"])
            out["checkpoints"] = digest(moved.groupBy("name").agg(F.max_by("position", "version").alias("position")))
        return out

    def verify(self, expected: dict[str, str]) -> bool:
        """Whether the tables are those of a backup."""
        for name, known in expected.items():
            rows = self._checkpoints() if name == "checkpoints" else self._table(name)
            if rows is not None and name == "checkpoints":
                rows = rows.groupBy("name").agg(F.max_by("position", "version").alias("position"))
            if rows is None or digest(rows) != known:
                return False
        return True


def digest(rows: DataFrame) -> str:
    """The count and an order-free hash of a table."""
    shown = F.to_json(F.struct(*[F.array_sort(F.map_entries(c)).alias(c) if t.startswith("map") else F.col(f"`{c}`") for c, t in sorted(rows.dtypes)]))
    n, total = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64(shown).cast("decimal(38,0)"))).first()
    return json.dumps({"rows": n, "hash": str(total or 0)})
