"""Group policy audit: directory changes, the facts that they carry, and the policy's name when each change happened.

Facts come from the same rows that are then answered, in two passes: all facts first, then
every change asks for the name that its policy had at its time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.functions import decode
from chronolith.functions.text import blank_to_empty, compose_account
from chronolith.operators import context
from chronolith.operators.views import typed
from chronolith.schema import payload
from chronolith.scratch import written

#: What an event id does to a directory object.
KINDS = ((5136, "Modified"), (5137, "Created"), (5139, "Moved"), (5141, "Deleted"))


def changes(rows: DataFrame) -> DataFrame:
    """(record_id, source_computer, at, kind, who, policy_id, object_class, object, old_object, new_object, object_guid, attribute, value, operation, correlation), one a directory change."""
    keys = ("ObjectClass", "ObjectDN", "OldObjectDN", "NewObjectDN", "ObjectGUID", "AttributeLDAPDisplayName", "AttributeValue", "OperationType", "OpCorrelationID", "SubjectDomainName", "SubjectUserName")
    # Each payload value is a column before it is used: an expression used twice would search the map twice.
    held = typed(rows, ["GroupPolicyDirectoryAudit"]).select("record_id", "source_computer", F.col("time_created").alias("at"), "event_id", *[payload(k).alias(k) for k in keys])
    text = lambda key: F.nullif(blank_to_empty(F.col(key)), F.lit(""))
    held = held.withColumn("object", F.coalesce(text("NewObjectDN"), text("ObjectDN"), text("OldObjectDN")))
    held = held.withColumn("_policy", F.regexp_extract("object", r"(?i)cn=(\{[0-9a-f-]+\}),cn=policies", 1))
    return held.select(
        "record_id", "source_computer", "at", decode.name_of(F.col("event_id"), KINDS).alias("kind"), compose_account(F.col("SubjectDomainName"), F.col("SubjectUserName")).alias("who"), decode.guid(F.col("_policy")).alias("policy_id"),
        text("ObjectClass").alias("object_class"), "object", text("OldObjectDN").alias("old_object"), text("NewObjectDN").alias("new_object"), decode.guid(F.col("ObjectGUID")).alias("object_guid"),
        text("AttributeLDAPDisplayName").alias("attribute"), text("AttributeValue").alias("value"), decode.operation(F.col("OperationType")).alias("operation"), text("OpCorrelationID").alias("correlation"),
    )


def facts(changed: DataFrame) -> DataFrame:
    """Context facts of the policies: an added display name is observed, a deleted one is observed as none."""
    mine = changed.where((F.upper("object_class") == "GROUPPOLICYCONTAINER") & F.col("policy_id").isNotNull())
    named = F.coalesce(F.upper("attribute") == "DISPLAYNAME", F.lit(False))
    added = named & F.coalesce(F.col("operation") == "Value Added", F.lit(False))
    return mine.select(
        F.lit("GroupPolicy").alias("object_kind"), F.col("policy_id").alias("canonical_id"), F.array_distinct(F.array_compact(F.array("object", "old_object", "new_object", "object_guid"))).alias("aliases"),
        F.when(added, F.col("value")).alias("display_name"), (named & F.coalesce(F.col("operation").isin("Value Added", "Value Deleted"), F.lit(False))).alias("display_name_observed"),
        F.col("at").alias("effective_at"), (F.col("kind") == "Deleted").alias("is_deleted"), F.lit(None).cast("string").alias("authorization_context"),
    )


def audit(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The changes with policy_status and policy_name as of each change; ``known`` are facts from elsewhere.

    Changes to what is no policy have null in both. The changes are read more than once, so they are written once.
    """
    changed = written(changes(rows), "policy-changes")
    told = facts(changed) if known is None else facts(changed).unionByName(known)
    policy = F.when(F.upper("object_class") == "GROUPPOLICYCONTAINER", F.col("policy_id"))
    return context.answered(changed.withColumn("_policy", policy), told, "GroupPolicy", "_policy", "at", "policy_status", "policy_name").drop("_policy")
