"""Canned reports: statistics, logons, lockouts, RC4 impact, decision metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronolith.functions.decode import LOGON_TYPES, integer, name_of
from chronolith.functions.text import account_domain, account_user, blank_to_empty
from chronolith.functions.times import receive_lag
from chronolith.operators.aggregate import by_dimensions
from chronolith.schema import payload


def statistics(rows: DataFrame, top: int | None = None) -> DataFrame:
    """(dimension, value, count) by event id, provider, computer and level; a blank provider is ``(unknown)``, a blank computer is left out."""
    provider = F.when(F.trim(F.coalesce("provider", F.lit(""))) == "", "(unknown)").otherwise(F.col("provider"))
    return by_dimensions(rows, {"event_id": F.col("event_id"), "provider": provider, "computer": F.col("source_computer"), "level": F.col("level")}, top)


def time_range(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("events"), F.min("time_created").alias("first_seen"), F.max("time_created").alias("last_seen"))


def _first(*keys: str) -> Column:
    return F.coalesce(*[F.nullif(blank_to_empty(payload(k)), F.lit("")) for k in keys], F.lit(""))


def failed_logons(rows: DataFrame, top: int | None = None) -> DataFrame:
    """Failed logons (id 4625) by eleven dimensions."""
    target = _first("TargetUserName", "AccountName")
    return by_dimensions(rows.where("event_id = 4625"), {
        "computer": F.col("source_computer"), "target_user": account_user(target), "target_domain": F.coalesce(account_domain(target), _first("TargetDomainName")),
        "logon_type": F.coalesce(name_of(integer(payload("LogonType")), LOGON_TYPES), _first("LogonType")), "ip": _first("IpAddress"), "workstation": _first("WorkstationName"),
        "status": _first("Status"), "sub_status": _first("SubStatus"), "failure_reason": _first("FailureReason"), "process": _first("ProcessName"), "authentication_package": _first("AuthenticationPackageName"),
    }, top)


def user_logons(rows: DataFrame, top: int | None = None) -> DataFrame:
    """Logon events (4624, 4625, 4634, 4647, 4672) by seven dimensions; special logons name the subject."""
    special = F.col("event_id") == 4672
    user = F.when(special, _first("SubjectUserName")).otherwise(_first("TargetUserName"))
    domain = F.when(special, _first("SubjectDomainName")).otherwise(_first("TargetDomainName"))
    return by_dimensions(rows.where(F.col("event_id").isin(4624, 4625, 4634, 4647, 4672)), {
        "event_id": F.col("event_id"), "computer": F.col("source_computer"), "user": user, "domain": domain,
        "logon_type": F.coalesce(name_of(integer(payload("LogonType")), LOGON_TYPES), _first("LogonType")), "ip": _first("IpAddress"), "workstation": _first("WorkstationName"),
    }, top)


def lockouts(rows: DataFrame, top: int | None = None) -> DataFrame:
    """Account lockouts (id 4740) by five dimensions; the caller is the event's TargetDomainName."""
    return by_dimensions(rows.where("event_id = 4740"), {"computer": F.col("source_computer"), "target_user": _first("TargetUserName"), "target_domain": _first("SubjectDomainName"), "caller": _first("TargetDomainName", "CallerComputerName"), "subject": _first("SubjectUserName")}, top)


def samples(rows: DataFrame, n: int) -> DataFrame:
    """The first rows by time."""
    return rows.orderBy("time_created", "record_id").limit(n)


#: What a KDC RC4 event says.
RC4_WARNING, RC4_BLOCK, RC4_DEFAULT = (201, 202, 206, 207), (203, 204, 208, 209), (205,)


def rc4_impact(rows: DataFrame, evidence: int = 25) -> DataFrame:
    """KDC RC4 audit events by domain controller, account, service, client, state and id: count, last time, first evidence ids."""
    taken = rows.where((F.upper("provider") == "KDCSVC") & (F.upper("source_log") == "SYSTEM") & F.col("event_id").between(201, 209))
    state = F.when(F.col("event_id").isin(*RC4_WARNING), "MayFailUnderEnforcement").when(F.col("event_id").isin(*RC4_BLOCK), "AlreadyBlocked").otherwise("ExplicitInsecureDefault")
    keyed = taken.select(F.col("source_computer").alias("controller"), _first("AccountName").alias("account"), _first("ServiceName").alias("service"), _first("ClientAddress").alias("client"), state.alias("state"), "event_id", "time_created", "record_id", "observation_identity")
    keys = ["controller", "account", "service", "client", "state", "event_id"]
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("time_created", "record_id"))
    shown = F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= evidence, F.struct("_n", "observation_identity")))), lambda x: x["observation_identity"])
    return keyed.withColumn("_n", number).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.max("time_created").alias("last_seen"), shown.alias("evidence"))


def decision_metrics(observations: DataFrame, findings: DataFrame, packs: int = 0, counters: dict[str, Column] | None = None) -> DataFrame:
    """(metric, value): eight base counters, receive lag, and counters of a profile, conditions on observations.

    Observations that share an identity count once, as the earliest.
    """
    first = F.row_number().over(Window.partitionBy("observation_identity").orderBy("time_created", "record_id"))
    seen = observations.withColumn("_n", first).where("_n = 1")
    filled = lambda c: F.when(F.trim(c) != "", F.upper(c))
    lag = receive_lag(F.col("received_time"), F.col("time_created"))
    a = seen.agg(
        F.count(F.lit(1)).cast("double").alias("ObservationCount"), F.countDistinct(filled(F.col("source_log"))).cast("double").alias("ChannelCount"), F.avg(lag).alias("AverageReceiveLagSeconds"), F.max(lag).alias("MaximumReceiveLagSeconds"),
        *[F.count_if(F.coalesce(c, F.lit(False))).cast("double").alias(n) for n, c in (counters or {}).items()],
    )
    targets = seen.select(F.explode(F.array(filled(F.col("source_computer")), filled(F.col("collector_computer")))).alias("t")).agg(F.countDistinct("t").cast("double").alias("TargetCount"))
    status = lambda s: F.count_if(F.col("status") == s).cast("double")
    b = findings.agg(F.count(F.lit(1)).cast("double").alias("FindingCount"), status("Matched").alias("MatchedFindingCount"), status("Incomplete").alias("IncompleteFindingCount"), status("Error").alias("ErrorFindingCount"))
    one = a.crossJoin(targets).crossJoin(b).withColumn("PackCount", F.lit(float(packs)))  # three rows into one
    return one.unpivot([], one.columns, "metric", "value")


#: Profiles: the counters that each adds, as lists of types.
PROFILE_TYPES = {
    "EventingIntegrity": {"ClearedLogCount": ("LogsClearedSecurity", "LogsClearedOther"), "AuditPolicyChangeCount": ("AuditPolicyChange",), "FullSecurityLogCount": ("LogsFullSecurity",)},
    "AuthenticationPosture": {"NtlmV1Count": ("ADUserLogonNTLMv1",), "FailedLogonCount": ("ADUserLogonFailed",), "SuccessfulLogonCount": ("ADUserLogon", "ADUserLogonNTLMv1")},
    "IdentityLifecycle": {"AccountStateChangeCount": ("ADUserStatus",), "MembershipChangeCount": ("ADGroupMembershipChange",)},
    "PrivilegedAccess": {"RightsAssignmentCount": ("ADUserRightsAssignment",), "SpecialPrivilegeLogonCount": ("ADUserPrivilegeUse",)},
    "GroupPolicyGovernance": {"GpoCreatedCount": ("GpoCreated",), "GpoModifiedCount": ("GpoModified", "ADGroupPolicyEdits", "ADGroupPolicyChangesDetailed"), "GpoLinkChangeCount": ("ADGroupPolicyLinks",), "GpoDeletedCount": ("GpoDeleted",)},
    "CertificateServicesGovernance": {"CertificateIssuedCount": ("CertificateIssued",)},
    "ExecutionAndPersistence": {"ScheduledTaskCount": ("ScheduledTaskCreated", "ScheduledTaskUpdated", "ScheduledTaskEnabled", "ScheduledTaskDisabled", "ScheduledTaskDeleted"), "FirewallRuleCount": ("FirewallRuleAdded", "FirewallRuleDeleted", "FirewallRuleChange"), "DefenderCount": ("DefenderThreatDetected", "DefenderThreatAction", "DefenderConfigurationChanged")},
}


def profile_counters(profile: str) -> dict[str, Column]:
    return {n: F.upper("type").isin([t.upper() for t in types]) for n, types in PROFILE_TYPES.get(profile, {}).items()}


def rc4_bound(rows: DataFrame, max_groups: int = 10_000) -> DataFrame:
    """(bound, value, allowed) if an RC4 report passes its number of groups, counted no further than one more; empty if it keeps it. Nothing is cut."""
    groups = rc4_impact(rows, 0).limit(max_groups + 1).agg(F.lit("groups").alias("bound"), F.count(F.lit(1)).alias("value"), F.lit(max_groups).cast("long").alias("allowed"))
    return groups.where("value > allowed")
