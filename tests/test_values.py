"""Normalized values, codes, typed columns, presets and policy names."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronolith.functions import decode, normalize
from chronolith.operators import detect, policy, rules, views
from chronolith.operators.predicates import Field, compare
from chronolith.schema import canonical
from chronolith.sources.store import Store

T0 = datetime(2024, 1, 1)
AUDIT = "Microsoft-Windows-Security-Auditing"
DDL = "record_id long, time_created timestamp, event_id int, source_log string, provider string, message string, values map<string,string>"


def rows_of(spark, rows):
    return canonical(spark.createDataFrame([(i, T0 + timedelta(minutes=i), e, log, provider, message, v) for i, e, log, provider, message, v in rows], DDL))


NORMALIZED = [
    ("UserAccountControl", "0x210", ("LOCKOUT, NORMAL_ACCOUNT", "FlagSet", "Normalized", True)),
    ("UserAccountControl", "4", ("UNKNOWN_0x4", "FlagSet", "Normalized", False)),
    ("NewUacValue", "none", ("NONE", "FlagSet", "Normalized", True)),
    ("OldUacValue", "zz", ("zz", "FlagSet", "Malformed", True)),
    ("whenCreated", "20240101120000.0Z", ("2024-01-01T12:00:00.000000Z", "DateTime", "Normalized", True)),
    ("pwdLastSet", "0", ("PasswordChangeRequired", "DirectorySentinel", "Normalized", True)),
    ("lastLogon", "9223372036854775807", (None, "DateTime", "Normalized", True)),
    ("lastLogon", "132537600000000001", ("2020-12-30T00:00:00.000000Z", "DateTime", "Normalized", False)),
    ("lastLogon", "-5", ("-5", "DateTime", "Malformed", True)),
    ("TargetSid", "s-1-5-21-1", ("S-1-5-21-1", "SecurityIdentifier", "Normalized", True)),
    ("ObjectGUID", "q", ("q", "Guid", "Malformed", True)),
    ("SomeOid", "1.2.3", ("1.2.3", "ObjectIdentifier", "Unchanged", True)),
    ("ObjectDN", "CN=a ; DC=b", ("CN=a,DC=b", "DistinguishedName", "Normalized", True)),
    ("SPN", "b;a;B", ("a, b", "MultiValue", "Normalized", True)),
    ("Other", "%%9", ("%%9", "ResourceIdentifier", "UnknownValue", True)),
    ("OperationType", "value added", ("Value Added", "DirectoryOperation", "Normalized", True)),
    ("Other", " y ", (" y ", "Text", "Unchanged", True)),
    ("Other", None, (None, "Text", "Unchanged", True)),
]


def test_normalized(spark):
    given = spark.createDataFrame([(i, f, v) for i, (f, v, _) in enumerate(NORMALIZED)], "i int, f string, v string")
    got = {r["i"]: r["n"] for r in given.select("i", normalize.normalized(F.col("f"), F.col("v")).alias("n")).collect()}
    for i, (field, value, expected) in enumerate(NORMALIZED):
        assert tuple(got[i][c] for c in ("value", "kind", "outcome", "lossless")) == expected, (field, value)


def test_normalized_payload_goes_by_siblings(spark):
    rows = spark.createDataFrame([({"AttributeLDAPDisplayName": "pwdLastSet", "AttributeValue": "0", "OperationType": "%%7"}, "GroupPolicyDirectoryAudit"), (None, None)], "values map<string,string>, type string")
    got = [r["n"] for r in rows.select(normalize.normalized_values(F.col("values"), F.col("type")).alias("n")).collect()]
    assert got[0]["AttributeValue"]["kind"] == "DirectorySentinel" and got[0]["OperationType"]["outcome"] == "UnknownValue" and got[1] is None


@pytest.mark.parametrize(
    "text, kind, expected",
    [
        ("0x80070005", "HResult", ("Failure", "HRESULT_FROM_WIN32(ERROR_ACCESS_DENIED)")),
        ("-2147467259", "HResult", ("Failure", "E_FAIL")),
        ("3010", "WindowsInstaller", ("SuccessRestartRequired", "ERROR_SUCCESS_REBOOT_REQUIRED")),
        ("3010", "Win32", ("Failure", None)),
        ("4294967296", "Win32", ("Unknown", None)),
        ("5", "Unknown", ("Unknown", None)),
    ],
)
def test_diagnostic_codes(spark, text, kind, expected):
    d = spark.createDataFrame([(text,)], "t string").select(decode.diagnostic_code(F.col("t"), kind).alias("d")).first()["d"]
    assert (d["outcome"], d["symbol"]) == expected


def test_code_names(spark):
    c = spark.createDataFrame([("SeTcbPrivilege", "SeNew", "Usb hub", "diskdrive", r"USB\\vid_046d&PID_1", 15)], "a string, b string, c string, d string, e string, f int")
    got = c.select(decode.privilege(F.col("a")), decode.privilege(F.col("b")), decode.device_type(F.col("c")), decode.device_type(F.col("d")), decode.vendor(F.col("e")), decode.name_of(F.col("f"), decode.PORT_TYPES), decode.name_of(F.lit(2202), decode.PROTECTORS)).first()
    assert tuple(got) == ("Act as part of the operating system", "SeNew", "USB Device", "Disk Drive", "Logitech", "Ethernet", "NumericalPassword")


def test_policy_links(spark):
    text = "[LDAP://cn={E6422062-F0B5-4760-ABCC-4075DA2D4094},cn=policies;2][LDAP://x;1]"
    links = spark.createDataFrame([(text,)], "t string").select(decode.policy_links(F.col("t")).alias("x")).first()["x"]
    assert [(x["guid"], x["enabled"], x["enforced"]) for x in links] == [("E6422062-F0B5-4760-ABCC-4075DA2D4094", True, True), (None, False, False)]


def test_typed_columns(spark):
    rows = rows_of(spark, [
        (1, 4768, "Security", AUDIT, "A ticket was requested.\n\nMore", {"TargetUserName": "u", "TargetDomainName": "D", "IpAddress": "::ffff:10.0.0.1", "TicketEncryptionType": "0x17", "SessionKeyEncryptionType": "0x12", "TicketOptions": "0x40810010"}),
        (2, 5139, "Security", AUDIT, None, {"ObjectClass": "user", "OldObjectDN": "a", "NewObjectDN": "b"}),
        (3, 7045, "System", "Service Control Manager", "x", {"ServiceName": "Npcap"}), (4, 7045, "System", "Service Control Manager", "npcap", {"ServiceName": "other"}), (5, 7045, "System", "Service Control Manager", "the NPF driver", {}),
    ])
    ticket = views.projected(rows, "KerberosTGTRequest").first()
    assert (ticket["account"], ticket["action"], ticket["ip_address"], ticket["encryption_type"], ticket["weak_encryption"], ticket["weak_session_key_encryption"]) == ("D\\u", "A ticket was requested.", "10.0.0.1", "RC4-HMAC", True, False)
    assert ticket["ticket_options"] == ["RenewableOk", "Canonicalize", "Renewable", "Forwardable"]
    moved = views.projected(rows, "ADUserChangeDetailed").first()
    assert (moved["object"], moved["field_value"]) == ("a", "b")
    assert sorted(r["record_id"] for r in views.projected(rows, "NetworkMonitorDriverLoaded").collect()) == [3, 5]
    for name in ("ADGroupPolicyLinks", "ADUserLogonFailed", "ADUserCreateChange", "ADGroupMembershipChange", "ScheduledTaskCreated", "FirewallRuleAdded", "DefenderThreatAction", "ADLdapBindingSummary", "DiskError"):
        assert views.projected(rows, name).columns[:6] == ["record_id", "computer", "action", "who", "account", "time"]


def test_presets(spark):
    directory = "Microsoft-Windows-ActiveDirectory_DomainService"
    rows = rows_of(spark, [
        (1, 4768, "Security", AUDIT, None, {"TicketEncryptionType": "0x17"}), (2, 4769, "Security", AUDIT, None, {"TicketEncryptionType": "0x12"}), (3, 4769, "Security", AUDIT, None, {"SessionKeyEncryptionType": "0x3", "weakencryptionalgorithm": "x"}),
        (4, 2887, "Directory Service", directory, None, {"NoNameA0": "0", "NoNameA1": "2"}), (5, 2887, "Directory Service", directory, None, {"NoNameA0": "0", "NoNameA1": "0"}), (6, 2889, "Directory Service", directory, None, None), (7, 4698, "Security", AUDIT, None, {}),
    ])
    assert sorted(r["record_id"] for r in views.preset(rows, "AuthenticationHealth").collect()) == [1, 3, 4, 6]
    assert [r["record_id"] for r in views.preset(rows, "ScheduledTaskActivity").collect()] == [7]


def test_policy_names_are_those_of_the_time(spark):
    guid = "e6422062-f0b5-4760-abcc-4075da2d4094"
    dn = f"CN={{{guid.upper()}}},CN=Policies,CN=System,DC=x"
    made = lambda i, event, **v: (i, event, "Security", AUDIT, None, {"ObjectClass": "groupPolicyContainer", "ObjectDN": dn, **v})
    rows = rows_of(spark, [
        made(1, 5137), made(2, 5136, AttributeLDAPDisplayName="displayName", AttributeValue="First", OperationType="%%14674"), made(3, 5136, AttributeLDAPDisplayName="versionNumber", AttributeValue="2", OperationType="%%14674"),
        made(4, 5136, AttributeLDAPDisplayName="displayName", AttributeValue="Second", OperationType="Value Added"), made(5, 5141), (6, 5136, "Security", AUDIT, None, {"ObjectClass": "organizationalUnit", "AttributeLDAPDisplayName": "gPLink"}),
    ])
    got = {r["record_id"]: (r["kind"], r["policy_id"], r["policy_status"], r["policy_name"]) for r in policy.audit(rows).collect()}
    assert got[1] == ("Created", guid, "Historical", None) and got[3] == ("Modified", guid, "Historical", "First")
    assert got[4] == ("Modified", guid, "Historical", "Second") and got[5][2] == "Deleted" and got[6] == ("Modified", None, None, None)


def test_a_broken_rule_stops_alone(spark):
    rows = canonical(spark.createDataFrame([(i, str(i), T0 + timedelta(minutes=i), "t", 1, {"v": "x" if i == 3 else str(i)}) for i in range(6)], "record_id long, observation_identity string, time_created timestamp, type string, event_id int, values map<string,string>"))
    good = rules.Rule("good", selector=rules.Selector(event_ids=(1,)))
    bad = rules.Rule("bad", selector=rules.Selector(types=("t",), predicate=compare("type", "GreaterThan", 5)))
    got = sorted((r["rule_id"], r["status"], r["evidence"]) for r in detect.evaluate_isolated(rows, [good, bad]).collect())
    assert got == [("bad", "Error", ["0"])] + [("good", "Matched", [str(i)]) for i in range(6)]


def test_bounds_report_instead_of_cutting(spark):
    rows = canonical(spark.createDataFrame([(i, str(i), T0 + timedelta(minutes=i), "t", f"c{i % 3}") for i in range(9)], "record_id long, observation_identity string, time_created timestamp, type string, source_computer string"))
    burst = [rules.Rule("burst", kind="Threshold", selector=rules.Selector(types=("t",)), threshold=3, window_seconds=3600, group_by="source_computer")]
    assert detect.evaluate_bounded(rows, burst).count() == 3
    only = detect.evaluate_bounded(rows, burst, max_groups=2, max_observations=8).collect()
    assert [(r["rule_id"], r["status"], r["evidence"]) for r in only] == [(detect.BOUNDS_RULE, "Incomplete", ["groups", "observations"])]


def test_store_detection_and_definitions(spark, tmp_path):
    rows = canonical(spark.createDataFrame([(i, T0 + timedelta(hours=i), "a" if i % 2 else "b", {"k": str(i)}) for i in range(8)], "record_id long, time_created timestamp, type string, values map<string,string>"))
    s = Store(spark, f"file://{tmp_path}/s")
    s.write(rows)
    found = s.detect([rules.Rule("r", selector=rules.Selector(types=("A",), predicate=Field("k") > 2))], start=T0 + timedelta(hours=4))
    assert found.count() == 2
    assert s.definition("d") == {} and s.define("d", {"x": "int"}) == {"x": "int"} and s.define("D", {"X": "int", "y": "string"}) == {"x": "int", "y": "string"}
    with pytest.raises(ValueError):
        s.define("d", {"X": "string"})
    assert s.definition("d") == {"x": "int", "y": "string"}
