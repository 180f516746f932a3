import random
from datetime import datetime
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from chronolith.functions import text
from chronolith.operators import occurrences, projection, rules, scan
from chronolith.operators import predicates as p
from chronolith.plans import catalogue
from chronolith.schema import CANONICAL, canonical
from chronolith.sources import files
from chronolith.streaming import streams

FOUND = "rule_id string, group_value string, status string, event_time timestamp, evidence array<string>"


def rows(spark, *given):
    made = spark.createDataFrame([(datetime(2024, 1, 1, 0, 0, s) if s is not None else None, log, i, who, str(i)) for s, log, i, who in given], "time_created timestamp, source_log string, record_id long, source_computer string, observation_identity string")
    return canonical(made)


def test_findings_carry_the_first_evidence_and_their_rule(spark):
    seen = rows(spark, (1, "A", 1, "x"), (2, "A", 2, "y"))
    seen = seen.unionByName(seen.where("record_id = 2").withColumn("time_created", F.lit(datetime(2024, 1, 1, 0, 5))).withColumn("source_computer", F.lit("later")))
    found = spark.createDataFrame([("r", "g", "Matched", datetime(2024, 1, 2), ["2", "1"]), ("s", None, "Incomplete", datetime(2024, 1, 3), []), ("t", "g", "Matched", None, ["gone"])], FOUND)
    part = projection.findings(found, seen, [rules.Rule("r", "Title", severity="High", tags=("a", "b"))])
    assert part.rows.schema == CANONICAL or part.rows.columns == CANONICAL.fieldNames()
    got = {r["rule_id"]: r.asDict() for r in projection.table(part).collect()}
    assert len(got) == 3 and got["r"]["source_computer"] == "y" and got["r"]["record_id"] == 2 and got["r"]["message"] == "Title Matched"
    assert (got["r"]["tags"], got["r"]["evidence"], got["r"]["evidence_count"]) == ("a, b", "2, 1", "2")
    assert got["s"]["source_computer"] is None and got["s"]["title"] is None and got["s"]["message"] == "s Incomplete" and got["s"]["group_value"] is None
    assert got["t"]["record_id"] is None and got["t"]["time_created"] is None
    clash = found.withColumn("title", F.lit("other")).withColumn("record_id", F.lit(9)).withColumn("message", F.lit("m"))
    assert {r["record_id"] for r in projection.table(projection.findings(clash, seen)).collect()} == {2, None}
    assert projection.table(projection.findings(found.limit(0), seen)).count() == 0


def test_every_section_is_one_table_and_says_its_columns(spark):
    entry = spark.createDataFrame([(datetime(2024, 1, 1), "Finding", "i", "t", [("Host", "h"), ("User", None)])], "time timestamp, entry string, identity string, title string, pivots array<struct<kind:string,value:string>>")
    metric = spark.createDataFrame([("ErrorCount", 2.0), ("MaximumReceiveLagSeconds", None)], "metric string, value double")
    parts = [projection.raw(rows(spark, (1, "A", 1, "x")), ["Key"]), projection.timeline(entry), projection.metrics(metric)]
    got = projection.report(parts)
    assert got.columns == CANONICAL.fieldNames() and sorted(r["type"] for r in got.collect()) == ["DecisionMetric", "DecisionMetric", "Generic", "IncidentTimeline"]
    assert [c for c in projection.described(parts) if c[0] == "IncidentTimeline"][-1] == ("IncidentTimeline", "Timeline", "pivots", "Pivots", "array<struct<kind:string,value:string>>", 4)
    assert projection.table(parts[1]).first()["pivots"] == "Host=h, User="
    shown = {r["metric"]: (r["value"], r["unit"], r["display_name"], r["time_created"]) for r in projection.table(parts[2]).collect()}
    assert shown == {"ErrorCount": ("2.0", "count", "Error Count", None), "MaximumReceiveLagSeconds": (None, "seconds", "Maximum Receive Lag Seconds", None)}


def test_scripts_are_laid_out_by_braces(spark):
    def plain(script):
        out, depth = [], 0
        for line in script.replace("\r", "").split("\n"):
            line = line.strip()
            depth = max(0, depth - 1) if line[:1] == "}" else depth
            out.append("    " * depth + line + "\n")
            depth += line[-1:] == "{"
        return "".join(out)

    dice = random.Random(3)
    cases = ["", "\r\n", "}\n}\na {\nb\n}\n}\nc {\n} else {\nd", "{\n" * 500] + ["\n".join(dice.choice(["{", "}", " x ", "} else {", "", "if {"]) for _ in range(dice.randint(1, 40))) for _ in range(60)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate([*cases, None])], "i int, s string")
    got = {r["i"]: r["o"] for r in df.select("i", text.indented(F.col("s")).alias("o")).collect()}
    assert got == {**{i: plain(c) for i, c in enumerate(cases)}, len(cases): None}
    assert got[2] == "}\n}\na {\n    b\n}\n}\nc {\n} else {\n    d\n"


def test_a_probe_says_why_a_log_has_no_event(spark):
    seen = rows(spark, (1, "App", 1, "x"), (5, "App", 2, "x"), (3, "Sys", 3, "y"), (None, "Odd", 4, "x"), (9, None, 5, "x"))
    logs = spark.createDataFrame([("APP",), ("app",), ("Sys",), ("Odd",), ("None",)], "source_log string")
    got = sorted((r["source_log"], r["status"], r["latest"] and r["latest"].second, r["events"], r["all_events"]) for r in scan.probe(seen, logs, p.Field("source_computer") == "x").collect())
    assert got == [("APP", "Ok", 5, 2, 2), ("None", "LogNotFound", None, 0, 0), ("Odd", "NoUsableTimestamp", None, 1, 1), ("Sys", "NoEvent", None, 0, 1), ("app", "Ok", 5, 2, 2)]
    assert {r["status"] for r in scan.probe(seen.limit(0), logs).collect()} == {"LogNotFound"}


def test_evidence_folders_know_what_changed(spark, tmp_path):
    path = f"file://{tmp_path}/e"
    seen = rows(spark, (1, "A", 1, "x"), (2, "B", 2, "y"))
    manifest = files.write_evidence({"one": seen, "none": seen.limit(0)}, path)
    assert files.verify_evidence(spark, path).count() == 0 and manifest.where("section = 'one'").count() >= 1
    data = [f for f in sorted((tmp_path / "e/data/section=one").glob("part-*")) if f.stat().st_size]
    data[0].write_bytes(b"{}\n")
    (data[0].parent / f".{data[0].name}.crc").unlink(missing_ok=True)
    (data[0].parent / "part-extra.json").write_bytes(b"{}\n")
    assert sorted(r["what"] for r in files.verify_evidence(spark, path).collect()) == ["changed", "extra"]
    data[0].unlink()
    assert sorted(r["what"] for r in files.verify_evidence(spark, path).collect()) == ["extra", "missing"]
    with pytest.raises(ValueError, match="section"):
        files.write_evidence({"../x": seen}, f"{path}2")


def test_many_events_are_many_whole_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FILE_ROWS", 10, raising=False)
    event = F.concat(F.lit("<Event><System><EventRecordID>"), F.col("id"), F.lit("</EventRecordID></System><EventData><Data Name='k'>a\nb</Data></EventData></Event>"))
    files.write_documents(spark.range(0, 50, 1, 2).select(event), f"file://{tmp_path}/d", "Events")
    found = [ElementTree.parse(f).getroot() for f in (tmp_path / "d").glob("part-*")]
    assert {r.tag for r in found} == {"Events"} and sorted(map(len, found)) == [1, 1, 8, 8, 8, 8, 8, 8]
    back = files.read_xml(spark, f"file://{tmp_path}/d")
    assert sorted((r["record_id"], r["values"]["k"]) for r in back.collect()) == [(i, "a\nb") for i in range(50)]
    made = catalogue.QUERIES["src_xml_files"](spark, "/root/testdata/sf0.001")
    assert made.count() == 1_000 and len(made.inputFiles()) >= 125


@pytest.mark.parametrize("kind", ["csv", "jsonl", "xml"])
def test_exports_are_files_of_bounded_rows(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(files, "FILE_ROWS", 10, raising=False)
    seen = rows(spark, *((i, "A", i, "x") for i in range(1, 36))).coalesce(1)
    files.export(seen, f"file://{tmp_path}/e", kind)
    assert files.export_manifest(spark, f"file://{tmp_path}/e").count() == 4
    got = catalogue.QUERIES["sink_manifest"](spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == [("changed", 2), ("whole", 0)]


def stream(spark, tmp_path, *given):
    rows(spark, *given).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    return spark.readStream.schema(CANONICAL).parquet(f"file://{tmp_path}/in")


def test_the_first_matches_are_taken_once_over_restarts(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    take = lambda src, most: streams.first_matches(src, out, f"{tmp_path}/at", most, availableNow=True).awaitTermination()
    assert streams.taken(spark, out) == 0
    take(stream(spark, tmp_path, (5, "A", 1, "x"), (3, "A", 2, "x")), 3)
    assert streams.taken(spark, out) == 2
    src = stream(spark, tmp_path, (9, "A", 3, "x"), (1, "A", 4, "x"), (2, "A", 5, "x"))
    take(src, 3)
    assert sorted(r["record_id"] for r in spark.read.parquet(out).collect()) == [1, 2, 4]
    for commit in (tmp_path / "at/commits").glob("*1*"):  # the last batch died before its commit: it runs again
        commit.unlink()
    take(src, 3)
    assert sorted(r["record_id"] for r in spark.read.parquet(out).collect()) == [1, 2, 4]


def test_a_folder_that_is_being_written_holds_no_matches_yet(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    (tmp_path / "out/batch=0/_temporary/0").mkdir(parents=True)  # a task is writing
    assert streams.taken(spark, out) == 0
    src = stream(spark, tmp_path, (5, "A", 1, "x"), (3, "A", 2, "x"))
    take = lambda: streams.first_matches(src, out, f"{tmp_path}/at", 3, availableNow=True).awaitTermination()
    take()
    before = sorted((tmp_path / "out/batch=0").glob("part-*"))
    for commit in (tmp_path / "at/commits").glob("*0*"):  # stopped behind the write: the batch runs again, its folder is not touched
        commit.unlink()
    take()
    assert streams.taken(spark, out) == 2 and sorted((tmp_path / "out/batch=0").glob("part-*")) == before


def test_watchers_say_why_they_ended(spark, tmp_path):
    src = stream(spark, tmp_path, (1, "A", 1, "x"))
    begin = lambda name, f=None: lambda: src.writeStream.foreachBatch(f or (lambda df, n: None)).option("checkpointLocation", f"{tmp_path}/cp-{name}").start()

    def fail(df, batch):
        raise RuntimeError("no")

    w = streams.Watchers()
    w.start("slow", begin("slow"), timeout=1.0)
    w.start("full", begin("full"), timeout=120, enough=lambda: True)
    w.start("broken", begin("broken", fail))
    w.start("named", begin("named"))
    by_id = w.start("by id", begin("id"))
    with pytest.raises(ValueError, match="running"):
        w.start("named", begin("named"))
    with pytest.raises(ValueError, match="positive"):
        w.start("none", begin("none"), timeout=0)
    assert w.find(by_id.id) == ["by id"]
    w.stop("named")
    w.stop(query_id=by_id.id)
    got = w.wait()
    assert {n: r.split(":")[0] for n, r in got.items()} == {"slow": "timeout", "full": "enough", "broken": "failed", "named": "stopped", "by id": "stopped"}
    assert not any(w.states().values())


def test_scripts_that_lack_parts_say_which(spark):
    given = [("whole", 1, 2), ("whole", 2, 2), ("whole", 2, 2), ("start", 2, 3), ("start", 3, 3), ("middle", 1, 3), ("middle", 3, 3), ("end", 1, 4), ("beyond", 1, 2), ("beyond", 5, 2), ("none", 1, None), ("meta", 0, 5)]
    parts = spark.createDataFrame(given, "script_block_id string, message_number int, message_total int")
    got = {r["script_block_id"]: tuple(r)[1:] for r in occurrences.incomplete(parts).collect()}
    assert got == {"start": (2, 3, 1, 1), "middle": (2, 3, 1, 2), "end": (1, 4, 3, 2), "beyond": (2, 2, 1, 2), "none": (1, None, None, None)}
    assert {tuple(r) for r in occurrences.script_bounds(parts, 5, 5, 1).collect()} == {("scripts", 6, 5), ("parts", 2, 1)}
    assert occurrences.script_bounds(parts.limit(0), 0, 0, 0).count() == 0
