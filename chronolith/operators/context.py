"""As-of resolution of directory objects from facts with an effective time.

Facts of one object at one time form a point: the name is what was observed then, or
carried forward from the last point that observed one; names that conflict at one time make
the point ambiguous; a deletion ends the carrying, so a recreated object starts without a
name. A question is answered by the last point at or before its time: Unknown, Deleted,
Ambiguous, Current (it is the object's last point) or Historical.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCOPE = ["object_kind", "scope", "canonical_id"]


def points(facts: DataFrame) -> DataFrame:
    """(object_kind, scope, canonical_id, at, name, deleted, ambiguous, is_last) from facts.

    Facts: object_kind, canonical_id, aliases, display_name, display_name_observed,
    effective_at, is_deleted, authorization_context. Ids compare without case.
    """
    f = facts.withColumn("canonical_id", F.upper("canonical_id")).withColumn("scope", F.coalesce("authorization_context", F.lit("")))
    seen = F.when(F.col("display_name_observed"), F.struct("display_name"))
    at = f.groupBy(*SCOPE, F.col("effective_at").alias("at")).agg(
        F.size(F.collect_set(seen["display_name"])).alias("_names"), F.max(seen["display_name"]).alias("_name"), F.bool_or(F.col("display_name_observed")).alias("_observed"),
        F.bool_or("is_deleted").alias("deleted"), F.bool_and("is_deleted").alias("_all_deleted"),
    )
    order = Window.partitionBy(*SCOPE).orderBy("at")
    life = F.coalesce(F.sum(F.col("deleted").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lived = at.withColumn("_life", life)
    carry = Window.partitionBy(*SCOPE, "_life").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("_observed"), F.struct("_name", (F.col("_names") > 1).alias("_clash"))), ignorenulls=True).over(carry)
    out = lived.withColumn("_held", held).withColumn("is_last", F.lead("at").over(order).isNull())
    return out.select(*SCOPE, "at", F.col("_held._name").alias("name"), "deleted", (F.coalesce(F.col("_held._clash"), F.lit(False)) | (F.col("deleted") & ~F.col("_all_deleted"))).alias("ambiguous"), "is_last")


def aliases(facts: DataFrame) -> DataFrame:
    """(object_kind, scope, alias, canonical_id, since): an alias is visible from its first fact on."""
    f = facts.withColumn("canonical_id", F.upper("canonical_id")).withColumn("scope", F.coalesce("authorization_context", F.lit("")))
    return f.select(*SCOPE, "effective_at", F.explode("aliases").alias("_a")).groupBy("object_kind", "scope", F.upper("_a").alias("alias"), "canonical_id").agg(F.min("effective_at").alias("since"))


def _status(point: Column) -> Column:
    """What a point, or none, says of its object."""
    return F.when(point.isNull(), "Unknown").when(point["ambiguous"], "Ambiguous").when(point["deleted"], "Deleted").when(point["is_last"], "Current").otherwise("Historical")


def answered(rows: DataFrame, facts: DataFrame, kind: str, key: str, time: str, status: str, name: str) -> DataFrame:
    """``rows`` with the status and name, as of ``time``, of the object of ``kind`` whose id is in ``key``; null where the id is null.

    The answers of ``resolve`` to a question by id for each row, without an authorization context. Rows and points go through one shuffle
    by id; nothing is joined back.
    """
    told = points(facts.where(F.col("object_kind") == kind)).where("scope = ''")
    told = told.select(F.col("canonical_id").alias("_id"), F.col("at").alias("_at"), F.lit(0).alias("_side"), F.struct("name", "deleted", "ambiguous", "is_last").alias("_point"))
    asked = rows.where(F.col(key).isNotNull()).withColumns({"_id": F.upper(key), "_at": F.col(time), "_side": F.lit(1)})
    before = Window.partitionBy("_id").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = asked.unionByName(told, allowMissingColumns=True).withColumn("_point", F.last("_point", ignorenulls=True).over(before)).where("_side = 1")
    found = found.withColumn(status, _status(F.col("_point")))
    found = found.withColumn(name, F.when(F.col(status).isin("Current", "Historical", "Deleted"), F.col("_point.name")))
    return found.select(*rows.columns, status, name).unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


def resolve(questions: DataFrame, facts: DataFrame) -> DataFrame:
    """Answers to questions (query_id, object_kind, canonical_id or alias, at, authorization_context).

    Points and questions of an object are put in one order and the last point is carried to
    each question, so an object's history is shuffled once and never multiplied by its
    questions. Columns: query_id, status, canonical_id, name.
    """
    asked = questions.select("query_id", "object_kind", F.coalesce("authorization_context", F.lit("")).alias("scope"), F.upper("canonical_id").alias("canonical_id"), F.upper("alias").alias("alias"), "at")
    by_id = asked.where(F.col("canonical_id").isNotNull()).drop("alias")
    known = aliases(facts)
    by_alias = asked.where(F.col("canonical_id").isNull() & F.col("alias").isNotNull()).drop("canonical_id").join(known, ["object_kind", "scope", "alias"]).where("since <= at").drop("since", "alias")
    wanted = by_id.unionByName(by_alias.select(*by_id.columns))
    timeline = points(facts).select(*SCOPE, "at", F.lit(0).alias("_side"), F.lit(None).cast(dict(asked.dtypes)["query_id"]).alias("query_id"), F.struct("name", "deleted", "ambiguous", "is_last").alias("_point"))
    stream = timeline.unionByName(wanted.select(*SCOPE, "at", F.lit(1).alias("_side"), "query_id"), allowMissingColumns=True)
    before = Window.partitionBy(*SCOPE).orderBy("at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = stream.withColumn("_point", F.last("_point", ignorenulls=True).over(before)).where("_side = 1 AND _point IS NOT NULL")
    per = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.first("canonical_id").alias("_id"), F.first("_point").alias("_p"))
    joined = asked.select("query_id", F.col("canonical_id").alias("_asked")).join(per, "query_id", "left")
    p = F.col("_p")
    status = F.when(F.col("_n") > 1, "Ambiguous").otherwise(_status(p))
    sure = status.isin("Current", "Historical", "Deleted")
    return joined.select("query_id", status.alias("status"), F.when(F.col("_n") == 1, F.col("_id")).otherwise(F.col("_asked")).alias("canonical_id"), F.when(sure, p["name"]).alias("name"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str]) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` at or before it with the same keys."""
    r = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*columns).alias("_right"))
    both = r.unionByName(left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*[f"`{c}`" for c in left.columns]).alias("_left")), allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_right", F.last("_right", ignorenulls=True).over(before)).where("_side = 1")
    return out.select("_left.*", *[F.col(f"_right.{c}").alias(c) for c in columns])
