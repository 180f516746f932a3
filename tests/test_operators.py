from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronolith.functions import decode, text, times
from chronolith.operators import aggregate as agg
from chronolith.operators import context, occurrences, privacy, scan, timeline, views
from chronolith.operators.predicates import compare
from chronolith.schema import canonical
from chronolith.sources import files, store

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def event_rows(spark, rows, ddl):
    return canonical(spark.createDataFrame(rows, ddl))


def test_dst_buckets_and_labels(spark):
    rows = spark.createDataFrame([(datetime(2024, 3, 10, 6, 30),), (datetime(2024, 3, 10, 7, 30),), (datetime(2024, 11, 3, 5, 30),), (datetime(2024, 11, 3, 6, 30),)], "t timestamp")
    zone = "America/New_York"
    day = times.calendar_start(F.col("t"), "Day", zone)
    hour = times.calendar_start(F.col("t"), "Hour", zone)
    got = rows.select(day.alias("d"), times.calendar_end(day, "Day", zone).alias("e"), hour.alias("h"), times.bucket_label(day, "Day", zone).alias("l")).collect()
    assert [(r["e"] - r["d"]).total_seconds() / 3600 for r in got] == [23, 23, 25, 25]
    assert [r["h"] for r in got] == [datetime(2024, 3, 10, 6), datetime(2024, 3, 10, 7), datetime(2024, 11, 3, 5), datetime(2024, 11, 3, 6)]
    assert got[0]["l"] == "2024-03-10 -05:00" and got[3]["l"] == "2024-11-03 -04:00"


def test_aggregation_nulls_case_and_text_times(spark):
    rows = spark.createDataFrame([("a", "x", "2024-01-01"), ("A", None, None), (None, "X", "2024-01-03"), ("b", "y", "2024-01-02")], "g string, v string, when string")
    d = agg.Definition(("g",), (agg.Measure("Count", "count"), agg.Measure("DistinctCount", "vs", "v", include_nulls=True), agg.Measure("LastSeen", "last", "when")))
    assert [tuple(r) for r in agg.aggregate(rows, d).collect()] == [(None, 1, 1, datetime(2024, 1, 3)), ("A", 2, 2, datetime(2024, 1, 1)), ("b", 1, 1, datetime(2024, 1, 2))]
    assert agg.aggregate(rows.where("false"), d).count() == 0
    assert agg.complete(rows, d, max_groups=2).first()["complete"] is False and agg.complete(rows, d, max_groups=3).first()["complete"] is True
    with pytest.raises(ValueError):
        agg.aggregate(rows, agg.Definition(("g", "G")))
    with pytest.raises(Exception):
        agg.aggregate(rows.withColumn("when", F.lit("no time")), d).collect()


def brute_semantic(groups, window):
    """groups: (name, first, last, causes)."""
    groups = sorted(groups, key=lambda g: (g[1], g[0]))
    cluster = {g[0]: {g[0]} for g in groups}
    span = {g[0]: [g[1], g[2]] for g in groups}
    of = {g[0]: g[0] for g in groups}
    by = {}
    for g in groups:
        for c in g[3]:
            by.setdefault(c, []).append(g[0])
    for c in sorted(by):
        now = by[c][0]
        for nxt in by[c][1:]:
            a, b = of[now], of[nxt]
            if a != b:
                lo, hi = min(span[a][0], span[b][0]), max(span[a][1], span[b][1])
                if hi - lo > window:
                    now = nxt
                    continue
                cluster[a] |= cluster.pop(b)
                span[a] = [lo, hi]
                for x in cluster[a]:
                    of[x] = a
            now = nxt
    return sorted(tuple(sorted(c)) for c in cluster.values())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_semantic_occurrences_equal_brute_force(spark, seed):
    import random

    rng = random.Random(seed)
    data = [(i, at(rng.randint(0, 90)), "p", "c", {k: f"{rng.randint(0, 5)}" for k in rng.sample(["CorrelationId", "TransactionId", "BatchId"], rng.randint(0, 2))}) for i in range(40)]
    rows = event_rows(spark, data, "record_id long, time_created timestamp, provider string, source_computer string, values map<string,string>")
    names = {r["record_id"]: r["occurrence"] for r in occurrences.transport(rows).collect()}
    back = {v: k for k, v in names.items()}
    groups = [(names[i], (t - T0).total_seconds(), (t - T0).total_seconds(), [f"{k.upper()}={v}" for k, v in m.items()]) for i, t, _, _, m in data if m]
    gold = sorted([tuple(sorted(back[n] for n in c)) for c in brute_semantic(groups, 10)] + [(i,) for i, _, _, _, m in data if not m])
    got = occurrences.semantic(rows, 10).groupBy("occurrence").agg(F.array_sort(F.collect_list("record_id")).alias("ids")).collect()
    assert sorted(tuple(r["ids"]) for r in got) == gold


def test_script_reassembly(spark):
    parts = spark.createDataFrame([("s", 2, 2, "b", at(1)), ("s", 1, 2, "a", at(0)), ("s", 1, 2, "dup", at(9)), ("s", 0, 2, "meta", at(0)), ("m", 2, 2, "only", at(0)), ("e", 1, 3, "x", at(0)), ("e", 3, 3, "z", at(0))], "script_block_id string, message_number int, message_total int, script_block_text string, time_created timestamp")
    assert sorted((r["script_block_id"], r["script"], r["complete"]) for r in occurrences.reassemble(parts).collect()) == [("e", "xz", False), ("m", "only", False), ("s", "ab", True)]


FACT = "object_kind string, canonical_id string, aliases array<string>, display_name string, display_name_observed boolean, effective_at timestamp, is_deleted boolean, authorization_context string"
ASK = "query_id int, object_kind string, canonical_id string, alias string, at timestamp, authorization_context string"


def test_context_resolution(spark):
    facts = [
        ("User", "A", ["al"], "one", True, at(10), False, None), ("User", "a", [], "two", True, at(20), False, None), ("User", "A", [], None, False, at(25), False, None), ("User", "A", [], None, False, at(30), True, None), ("User", "A", [], None, False, at(40), False, None),
        ("User", "B", ["al"], "x", True, at(15), False, None), ("User", "C", [], "p", True, at(10), False, None), ("User", "C", [], "q", True, at(10), False, None), ("User", "D", [], "secret", True, at(1), False, "t1"),
    ]
    asked = [(1, "A", None, 5), (2, "a", None, 10), (3, "A", None, 27), (4, "A", None, 30), (5, "A", None, 99), (6, None, "AL", 12), (7, None, "al", 16), (8, None, "al", 9), (9, "C", None, 11), (10, "D", None, 5), (11, "Z", None, 5), (12, "B", None, 15)]
    questions = spark.createDataFrame([(i, "User", c, a, at(s), None) for i, c, a, s in asked] + [(13, "User", "D", None, at(5), "t1")], ASK)
    got = {r["query_id"]: (r["status"], r["name"]) for r in context.resolve(questions, spark.createDataFrame(facts, FACT)).collect()}
    assert got == {1: ("Unknown", None), 2: ("Historical", "one"), 3: ("Historical", "two"), 4: ("Deleted", "two"), 5: ("Current", None), 6: ("Historical", "one"), 7: ("Ambiguous", None), 8: ("Unknown", None), 9: ("Ambiguous", None), 10: ("Unknown", None), 11: ("Unknown", None), 12: ("Current", "x"), 13: ("Current", "secret")}


def test_flat_filters(spark):
    rows = event_rows(spark, [(1, {"K": "v", "L": "w"}), (2, {"k": "V"}), (3, {}), (4, None)], "record_id long, values map<string,string>")
    ids = lambda f: [r["record_id"] for r in rows.where(f.column()).collect()]
    assert ids(scan.Filter(named_data=(("k", ("v",)),))) == [1] and ids(scan.Filter(data=("V",))) == [2]
    assert ids(scan.Filter(excluded_named_data=(("k", ("v", "V")), ("l", ("w",))))) == [2, 3, 4]
    assert scan.intersect(scan.Filter(event_ids=(1,)), scan.Filter(event_ids=(2,))) is None
    assert scan.generic_columns(rows, most=1).columns[-1] == "Details"


def test_periods():
    now = datetime(2024, 3, 31, 12, 34)
    assert times.period("PastMonth", now) == (datetime(2024, 2, 1), datetime(2024, 3, 1)) and times.period("PastQuarter", now) == (datetime(2023, 10, 1), datetime(2024, 1, 1))
    assert times.period("TillLastSunday", now)[0] == datetime(2024, 3, 31) and times.period("TillLastMonday", now)[0] == datetime(2024, 3, 25)
    assert times.period("Last30Minutes", now) == (datetime(2024, 3, 31, 12, 4), now) and times.period("Everything", now) == (None, None)
    with pytest.raises(ValueError):
        times.period("Sometime", now)


def test_scalar_functions(spark):
    one = spark.createDataFrame([(r"DOM\bob", "::ffff:1.2.3.4", "0x1F", "42", "20240102030405.5Z", "{6F9619FF8B86D011B42D00C04FC964FF}", "a; B\nb;;c", "first\r\nline\r\n\r\nrest")], "acc string, ip string, hex string, num string, gt string, g string, m string, msg string")
    r = one.select(
        text.account_domain(F.col("acc")).alias("d"), text.account_user(F.col("acc")).alias("u"), text.normalize_ip(F.col("ip")).alias("ip"), decode.integer(F.col("hex")).alias("h"), decode.integer(F.col("num")).alias("n"), decode.integer(F.col("m")).alias("bad"), times.from_generalized(F.col("gt")).alias("gt"),
        decode.guid(F.col("g")).alias("g"), text.distinct_values(F.col("m")).alias("m"), text.message_subject(F.col("msg")).alias("s"), text.message_line(F.col("msg"), 3).alias("l"), text.truncate(F.col("acc"), 4).alias("t"), text.longest(F.col("num"), F.col("acc")).alias("lo"), decode.distinguished_name(F.lit("CN = a ;  DC=b")).alias("dn"),
        text.split_words(F.lit("SubjectUserName")).alias("w"), text.blank_to_empty(F.lit(" - ")).alias("b"), times.from_filetime(F.lit(0)).alias("never"), decode.mask_matches(F.lit(6), 1, 4).alias("mask"),
    ).first()
    assert (r["d"], r["u"], r["ip"], r["h"], r["n"], r["bad"]) == ("DOM", "bob", "1.2.3.4", 31, 42, None) and r["gt"] == datetime(2024, 1, 2, 3, 4, 5, 500000)
    assert r["g"] == "6f9619ff-8b86-d011-b42d-00c04fc964ff" and r["m"] == ["a", "B", "c"] and (r["s"], r["l"], r["t"], r["lo"]) == ("first\nline", "rest", "DOM…", r"DOM\bob")
    assert (r["dn"], r["w"], r["b"], r["never"], r["mask"]) == ("CN=a,DC=b", "Subject User Name", "", None, True)
    assert text.snake_case("IPAddress") == "ip_address" and text.snake_case("SubjectUserName") == "subject_user_name"


def test_views(spark):
    assert len(views.LEAVES) == 102 and len(views.COMPOSITES) == 14
    leaves = views.expand(["InfrastructureHealth", "OSStartup"])
    assert leaves[0] == "OSStartup" and len(leaves) == len(set(leaves)) == 27
    assert views.sources(["LogsClearedOther", "LogsFullSecurity"]) == {"System": ({104}, {"Microsoft-Windows-Eventlog"}), "Security": ({1104}, {"Microsoft-Windows-Eventlog"})}
    audit = "microsoft-windows-security-auditing"
    rows = event_rows(spark, [(1, 5136, "Security", audit, {"ObjectClass": "user"}), (2, 5136, "Security", audit, {"ObjectClass": "groupPolicyContainer"}), (3, 10, "Microsoft-Windows-DHCP Server/Operational", "x", {}), (4, 4741, "System", audit, {})], "record_id long, event_id int, source_log string, provider string, values map<string,string>")
    assert sorted((r["record_id"], r["type"]) for r in views.typed(rows, [n for n, *_ in views.LEAVES]).collect()) == [(1, "ADUserChangeDetailed"), (2, "ADGroupPolicyChanges")]


def test_privacy(spark):
    rows = event_rows(spark, [(1, {"User": "bob", "Ip": "1", "Other": "x"}), (2, {"user": "bob"}), (3, None)], "record_id long, values map<string,string>")
    got = {r["record_id"]: r["values"] for r in privacy.project(rows, ["ip"], ["User"], b"k" * 32).collect()}
    assert got[1]["Ip"] == "1" and "Other" not in got[1] and got[1]["User"] == got[2]["User"] and got[1]["User"].startswith("hmac-sha256:") and got[3] is None
    with pytest.raises(ValueError):
        privacy.token("x", F.lit("y"), b"short")


def test_store(spark, tmp_path):
    rows = event_rows(spark, [(i, at(i * 40_000), "a" if i % 2 else "b", {"k": str(i)}) for i in range(10)], "record_id long, time_created timestamp, type string, values map<string,string>")
    s = store.Store(spark, f"file://{tmp_path}/s")
    s.write(rows.limit(6))
    s.write(rows.unionByName(rows))
    assert s.read().count() == 10 and s.read(compare("k", "GreaterThan", 7)).count() == 2
    hashes = s.backup(f"file://{tmp_path}/b")
    assert store.Store(spark, f"file://{tmp_path}/b").verify(hashes)
    s.prune(at(200_000), ["A"])
    assert sorted(r["record_id"] for r in s.read().collect()) == [0, 2, 4, 5, 6, 7, 8, 9] and not s.verify(hashes)
    s.write(rows)
    assert s.read().count() == 10
    assert s.checkpoint("c") is None and s.move_checkpoint("c", None, "1") and not s.move_checkpoint("c", None, "2") and s.move_checkpoint("c", "1", "2") and s.checkpoint("c") == "2"
    findings = spark.createDataFrame([("r", "g", "Matched", at(0), ["x", "y"])], "rule_id string, group_value string, status string, event_time timestamp, evidence array<string>")
    s.write_findings(findings)
    s.write_findings(findings)
    assert s.findings("y").count() == 1 and s.findings("z").count() == 0


def test_backup_holds_every_table(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    s.write(event_rows(spark, [(1, at(0), "a")], "record_id long, time_created timestamp, type string"))
    s.write_findings(spark.createDataFrame([("r", "g", "Matched", at(0), ["x"])], "rule_id string, group_value string, status string, event_time timestamp, evidence array<string>"))
    s.move_checkpoint("c", None, "1")
    s.define("logon", {"User": "string"})
    hashes = s.backup(f"file://{tmp_path}/b")
    copy = store.Store(spark, f"file://{tmp_path}/b")
    assert sorted(hashes) == ["checkpoints", "definitions", "events", "findings"] and copy.verify(hashes)
    assert copy.definition("logon") == {"User": "string"} and copy.checkpoint("c") == "1"
    s.define("logon", {"Ip": "string"})
    assert not s.verify(hashes)


def test_files(spark, tmp_path):
    (tmp_path / "e.xml").write_text('<Events><Event xmlns="u"><System><Provider Name="p"/><EventID Qualifiers="0">7</EventID><TimeCreated SystemTime="2024-01-01T00:00:01.5Z"/><EventRecordID>3</EventRecordID><Channel>L</Channel><Computer>c</Computer></System><EventData><Data Name="k">v</Data><Data></Data><Data>w</Data></EventData></Event></Events>')
    r = files.read_xml(spark, f"{tmp_path}/e.xml").first()
    assert (r["record_id"], r["provider"], r["values"]) == (3, "p", {"k": "v", "NoNameA1": "w"}) and r["time_created"] == datetime(2024, 1, 1, 0, 0, 1, 500000)
    (tmp_path / "l.log").write_text('<![LOG[one\ntwo]LOG]!><time="03:04:05.6+060" date="1-2-2024" component="c" context="" type="1" thread="9" file="f">\n<![LOG[x]LOG]!><time="03:04:06.6-060" date="1-2-2024" component="c" context="" type="2" thread="9" file="f">\n')
    got = files.read_framed_log(spark, f"{tmp_path}/l.log").orderBy("time").collect()
    assert sorted((g["text"], g["type"]) for g in got) == [("one\ntwo", 1), ("x", 2)]
    rows = event_rows(spark, [(1, "a,\"b\"\nc", {"k": "1"})], "record_id long, message string, values map<string,string>")
    for kind in ("csv", "jsonl", "xml"):
        files.export(rows, f"{tmp_path}/{kind}", kind)
    assert files.read_json_lines(spark, f"{tmp_path}/jsonl").first()["values"] == {"k": "1"}
    assert files.report_files({"s": rows, "t": rows.where("false")}, f"{tmp_path}/r") == {"s": 1, "t": 0}
    bundle = files.evidence_bundle({"a": b"1", "b": b"2"})
    assert files.verify_bundle(bundle) == [] and bundle == files.evidence_bundle({"b": b"2", "a": b"1"})
    import io
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(bundle)) as src, zipfile.ZipFile(z, "w") as dst:
        dst.writestr("a", b"changed")
        dst.writestr("manifest.json", src.read("manifest.json"))
    assert files.verify_bundle(z.getvalue()) == ["changed a", "missing b"]


def test_investigation_and_clock(spark):
    ddl = "time timestamp, identity string, title string, fields map<string,string>"
    obs, found = spark.createDataFrame([(at(2), "o", "O", {"Who": "bob"}), (at(1), "p", "P", {"Who": "-"})], ddl), spark.createDataFrame([(at(2), "f", "F", {"TargetUserName": "BOB"})], ddl)
    assert [r["identity"] for r in timeline.investigation(obs, found).collect()] == ["p", "f", "o"]
    assert [r["identity"] for r in timeline.investigation(obs, found, "Account", "Bob").collect()] == ["f", "o"]
    assert spark.range(1).select(timeline.clock_order(F.lit(1), F.lit(2), F.lit(3), F.lit(4)).alias("x")).first()["x"] == "Before"


def test_enrichment_and_triage(spark):
    from chronolith.operators import enrich

    rows = spark.createDataFrame([(1, "1.1.1.1"), (2, "1.1.1.1"), (3, None), (4, "9.9.9.9")], "id int, ip string")
    got = {r["id"]: r["host_name"] for r in enrich.resolve_names(rows, "ip", lookup=lambda a: {"1.1.1.1": "one"}.get(a)).collect()}
    assert got == {1: "one", 2: "one", 3: None, 4: None}
    assert [r["id"] for r in enrich.keep(rows, F.col("id") > 1, lambda pdf: pdf["id"] % 2 == 0).orderBy("id").collect()] == [2, 4]
    text = "AzureAdJoined : YES\n   TenantName : x\nDomainJoined : NO"
    out = enrich.triage(spark.createDataFrame([(text,)], "t string"), "t", {"not joined": compare("DomainJoined", "Equal", "no"), "no tenant": compare("TenantName", "IsNull")}).first()
    assert out["failed_checks"] == ["not joined"] and out["fields"]["TenantName"] == "x"
    xml = spark.createDataFrame([('<Event xmlns="u"><System><EventID>7</EventID></System></Event>',), (None,)], "x string")
    assert [r[0] for r in xml.select(files.matches_xpath("x", "/Event/System[EventID=7]")).collect()] == [True, False]


def test_command_line(spark, tmp_path, capsys):
    from chronolith import cli

    rows = event_rows(spark, [(i, at(i), "a" if i % 3 else "b", {"k": str(i)}) for i in range(9)], "record_id long, time_created timestamp, type string, values map<string,string>")
    rows.write.parquet(f"{tmp_path}/rows")
    assert cli.main(["query", f"{tmp_path}/rows", "--where", "k > 4 and type == 'a'", "--limit", "2"], spark) == 0
    assert capsys.readouterr().out.count("record_id") == 2
    assert cli.main(["measure", f"{tmp_path}/rows", "--by", "type", "--bucket", "Day"], spark) == 0
    assert '"count":6' in capsys.readouterr().out
    assert cli.main(["detect", f"{tmp_path}/rows"], spark) == 0
    assert cli.main(["types"], spark) == 0 and "ADUserLogon" in capsys.readouterr().out
    assert cli.main(["store", f"{tmp_path}/rows", f"file://{tmp_path}/st"], spark) == 0 and store.Store(spark, f"file://{tmp_path}/st").read().count() == 9


def test_prune_survives_a_crash(spark, tmp_path, monkeypatch):
    rows = event_rows(spark, [(i, at(i * 40_000), "a" if i % 2 else "b") for i in range(10)], "record_id long, time_created timestamp, type string")
    ids = lambda s: sorted(r["record_id"] for r in s.read().collect())
    s = store.Store(spark, f"file://{tmp_path}/s")
    s.write(rows)
    real = store.Store._mend
    calls = []

    def dies(self):
        calls.append(1)
        if len(calls) == 2:  # the swap is decided, nothing has moved
            raise RuntimeError("lost")
        real(self)

    monkeypatch.setattr(store.Store, "_mend", dies)
    with pytest.raises(RuntimeError):
        s.prune(at(200_000), ["A"])
    monkeypatch.setattr(store.Store, "_mend", real)
    assert ids(store.Store(spark, f"file://{tmp_path}/s")) == [0, 2, 4, 5, 6, 7, 8, 9]
    s.prune(at(400_000))
    assert not (tmp_path / "s" / "swap.txt").exists()

    s.write(rows)
    fs, path = s._files()
    staged = tmp_path / "s" / "_staged-x" / "day=2024-01-01"  # a run that died before its swap was decided
    staged.mkdir(parents=True)
    assert ids(s) == list(range(10))


def test_two_writers_of_a_checkpoint(spark, tmp_path, monkeypatch):
    a, b = (store.Store(spark, f"file://{tmp_path}/s") for _ in "ab")
    assert a.move_checkpoint("c/1", None, "1")
    seen = b._checkpoint("c/1")
    monkeypatch.setattr(b, "_checkpoint", lambda name: seen)  # b read before a moved on
    assert a.move_checkpoint("c/1", "1", "2") and not b.move_checkpoint("c/1", "1", "3") and a.checkpoint("c/1") == "2" and a.checkpoint("other") is None


def test_transport_and_representative(spark):
    ddl = "record_id long, source_computer string, source_log string, container_log string, collector_computer string, provider string, event_id int, time_created timestamp, values map<string,string>"
    rows = event_rows(spark, [
        (1, "pc", "Sec", "ForwardedEvents", "hub", "p", 5, at(0), {"a": "1", "b": "2"}), (1, " PC ", "sec", "Sec", "pc", "P", 5, at(0), {"a": "1", "b": " "}),
        (2, "pc", "Sec", "ForwardedEvents", "hub", "p", 5, at(1), {"a": "1"}), (2, "pc", "Sec", "sec", "PC", "p", 5, at(1), {"a": "1"}),
        (3, " ", "Sec", "Sec", "pc", "p", 5, at(2), {}), (3, " ", "Sec", "x", "pc", "p", 5, at(2), {}), (None, "pc", "Sec", "Sec", "pc", "p", 5, at(3), None), (4, "pc", None, "Sec", "pc", "p", 5, at(3), None), (4, "pc", None, "y", "pc", "p", 5, at(3), None),
    ], ddl)
    got = sorted(((r["record_id"], r["container_log"], r["copies"]) for r in occurrences.representative(occurrences.transport(rows)).collect()), key=str)
    assert got == sorted([(1, "ForwardedEvents", 2), (2, "sec", 2), (3, "Sec", 1), (3, "x", 1), (None, "Sec", 1), (4, "Sec", 1), (4, "y", 1)], key=str)
    whole, passed = occurrences.bounded(rows, occurrences.transport)
    assert whole.count() == 9 and passed == []
    assert [x if i else x.count() for i, x in enumerate(occurrences.bounded(rows, occurrences.transport, max_observations=8, max_groups=6))] == [0, ["groups", "observations"]]


def test_policy_changes_that_share_a_row_are_answered_apart(spark):
    from chronolith.operators import policy
    from chronolith.schema import canonical

    guid = lambda n: f"00000000-0000-0000-0000-{n:012d}"
    change = lambda i, n, s, event, name: (i, datetime(2024, 1, 1, 0, 0, s), event, "DC", {"ObjectClass": "groupPolicyContainer", "ObjectDN": f"CN={{{guid(n)}}},CN=Policies,DC=x", "AttributeLDAPDisplayName": "displayName" if name else "versionNumber", "AttributeValue": name or "1", "OperationType": "%%14674"})
    link = (9, datetime(2024, 1, 1), 5136, "DC", {"ObjectClass": "site", "ObjectDN": "CN=s", "AttributeLDAPDisplayName": "gPLink"})
    given = [change(1, 1, 1, 5136, "one"), change(2, 2, 1, 5136, "two"), change(3, 1, 2, 5136, None), change(3, 2, 2, 5141, None), change(4, 1, 3, 5136, None), link]
    made = spark.createDataFrame(given, "record_id long, time_created timestamp, event_id int, source_computer string, values map<string,string>")
    log = canonical(made.withColumn("provider", F.lit("Microsoft-Windows-Security-Auditing")).withColumn("source_log", F.lit("Security")))
    got = {(r["record_id"], (r["policy_id"] or "")[-1:]): (r["policy_status"], r["policy_name"]) for r in policy.audit(log).collect()}
    assert got == {(1, "1"): ("Historical", "one"), (2, "2"): ("Historical", "two"), (3, "1"): ("Historical", "one"), (3, "2"): ("Deleted", "two"), (4, "1"): ("Current", "one"), (9, ""): (None, None)}
