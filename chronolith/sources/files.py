"""Readers and writers of event files: XML, JSON lines, text logs, reports and evidence bundles."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from chronolith.schema import COMMON, canonical

#: Rows of a file that is written here: one that is read or hashed as a whole is read by one task.
FILE_ROWS = 100_000

#: One rendered event; named and unnamed data keep their order.
_EVENT_XML = (
    "System struct<Provider:struct<_Name:string,_Guid:string>,EventID:string,Version:short,Level:short,Task:int,Opcode:short,Keywords:string,TimeCreated:struct<_SystemTime:string>,EventRecordID:long,"
    "Correlation:struct<_ActivityID:string,_RelatedActivityID:string>,Execution:struct<_ProcessID:int,_ThreadID:int>,Channel:string,Computer:string>,"
    "EventData struct<Data:array<struct<_Name:string,_VALUE:string>>>, RenderingInfo struct<Message:string,Level:string>"
)


def payload_map(data: Column) -> Column:
    """A map of data elements; an unnamed one is ``NoNameA{i}``, i counting unnamed ones also where they are empty."""
    blank = lambda x: F.coalesce(F.trim(x["_Name"]), F.lit("")) == ""
    numbered = F.transform(data, lambda x, i: F.struct(x["_Name"].alias("name"), x["_VALUE"].alias("value"), F.size(F.filter(F.slice(data, F.lit(1), i), blank)).alias("n"), blank(x).alias("blank")))
    kept = F.filter(numbered, lambda x: ~x["blank"] | (F.coalesce(x["value"], F.lit("")) != ""))
    entries = F.transform(kept, lambda x: F.struct(F.when(x["blank"], F.concat(F.lit("NoNameA"), x["n"].cast("string"))).otherwise(x["name"]).alias("key"), x["value"].alias("value")))
    first = F.aggregate(entries, F.filter(entries, lambda _: F.lit(False)), lambda seen, e: F.when(F.exists(seen, lambda s: F.lower(s["key"]) == F.lower(e["key"])), seen).otherwise(F.concat(seen, F.array(e))))
    return F.map_from_entries(F.coalesce(first, F.filter(entries, lambda _: F.lit(False))))


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """Canonical rows of files of ``<Event>`` elements."""
    raw = spark.read.schema(_EVENT_XML).format("xml").option("rowTag", "Event").option("ignoreNamespace", "true").option("attributePrefix", "_").load(path)
    return _from_system(raw)


def _enclosed(batches: Iterator[pa.RecordBatch], root: str, most: int) -> Iterator[pa.RecordBatch]:
    """The lines of a task as documents of ``most`` lines, the last one shorter: the tags of ``root`` around elements."""
    lines = lambda x: pa.RecordBatch.from_arrays([x], names=["value"])
    line = lambda x: lines(pa.array([x], pa.string()))
    room = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            if not room:
                yield line(f"<{root}>")
                room = most - 2
            part = batch.column(0).slice(at, room)
            yield lines(part)
            at, room = at + len(part), room - len(part)
            if not room:
                yield line(f"</{root}>")
    if room:
        yield line(f"</{root}>")


def write_documents(elements: DataFrame, path: str, root: str) -> None:
    """Writes a column of XML elements, one a row, as whole documents of at most FILE_ROWS lines.

    A document is a file: XML is read as a whole by one task, so documents are bounded and not one for all rows. Without rows there is no document.
    """
    most = FILE_ROWS
    whole = elements.toDF("value").mapInArrow(lambda it: _enclosed(it, root, most), "value string")
    whole.write.option("maxRecordsPerFile", most).text(path)


def project_xml(df: DataFrame, column: str = "raw_xml") -> DataFrame:
    """Canonical rows of a column with one rendered event each."""
    parsed = F.from_xml(F.regexp_replace(column, r"\sxmlns=(\"[^\"]*\"|'[^']*')", ""), _EVENT_XML, {"attributePrefix": "_", "ignoreNamespace": "true"})
    return _from_system(df.select(parsed.alias("e")).select("e.*"))


def matches_xpath(column: str, expression: str) -> Column:
    """Whether an XPath 1.0 expression holds for a column of event XML; two-valued."""
    return F.coalesce(F.xpath_boolean(F.regexp_replace(column, r"\sxmlns=(\"[^\"]*\"|'[^']*')", ""), F.lit(expression)), F.lit(False))


def _from_system(raw: DataFrame) -> DataFrame:
    s = F.col("System")
    names = F.create_map(*[F.lit(x) for pair in ((0, "LogAlways"), (1, "Critical"), (2, "Error"), (3, "Warning"), (4, "Information"), (5, "Verbose")) for x in pair])
    strip = lambda c: F.lower(F.regexp_replace(c, "[{}]", ""))
    made = raw.select(
        F.try_to_timestamp(s["TimeCreated"]["_SystemTime"]).alias("time_created"), s["EventID"].cast("int").alias("event_id"), s["EventRecordID"].alias("record_id"), s["Provider"]["_Name"].alias("provider"), s["Channel"].alias("source_log"), s["Channel"].alias("container_log"),
        s["Computer"].alias("source_computer"), F.coalesce(F.col("RenderingInfo.Level"), F.element_at(names, s["Level"].cast("int"))).alias("level"), s["Level"].alias("level_value"), strip(s["Correlation"]["_ActivityID"]).alias("activity_id"), strip(s["Correlation"]["_RelatedActivityID"]).alias("related_activity_id"),
        s["Execution"]["_ProcessID"].alias("process_id"), s["Execution"]["_ThreadID"].alias("thread_id"), F.col("RenderingInfo.Message").alias("message"), payload_map(F.coalesce(F.col("EventData.Data"), F.expr("CAST(array() AS array<struct<_Name:string,_VALUE:string>>)"))).alias("values"),
    )
    return canonical(made)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Canonical rows of JSON lines with canonical names."""
    from chronolith.schema import CANONICAL

    return canonical(spark.read.schema(CANONICAL).json(path))


#: A framed log record: text, time, date, component, context, type, thread, file.
_FRAME = r'(?s)<!\[LOG\[(.*?)\]LOG\]!><time="(\d\d:\d\d:\d\d)\.(\d+)([+-]\d+)?" date="(\d\d?)-(\d\d?)-(\d{4})" component="([^"]*)" context="([^"]*)" type="(\d*)" thread="(\d*)"'


def read_framed_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, text, time, component, context, type, thread) of framed text logs; a record may span lines."""
    raw = spark.read.option("lineSep", ">\n").text(path).select(F.input_file_name().alias("file"), "value")
    part = lambda n: F.regexp_extract("value", _FRAME, n)
    stamp = F.concat(part(7), F.lit("-"), F.lpad(part(5), 2, "0"), F.lit("-"), F.lpad(part(6), 2, "0"), F.lit(" "), part(2), F.lit("."), F.rpad(F.substring(part(3), 1, 6), 6, "0"))
    local = F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))
    bias = F.coalesce(part(4).try_cast("long"), F.lit(0))  # minutes that UTC is ahead
    time = F.timestamp_micros(F.unix_micros(local) + bias * 60_000_000)
    return raw.where(F.col("value").rlike(_FRAME)).select("file", part(1).alias("text"), time.alias("time"), part(8).alias("component"), part(9).alias("context"), part(10).try_cast("int").alias("type"), part(11).try_cast("int").alias("thread"))


#: A line of a plain log that begins a record: a time and, behind it, perhaps a level.
_PLAIN = r"(?i)^\[?(\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d(?:[.,]\d{1,6})?(?:Z|[+-]\d\d:?\d\d)?)\]?\s*(?:[:|-]?\s*\[?(TRACE|DEBUG|INFO|INFORMATION|WARN|WARNING|ERROR|FATAL|CRITICAL)\]?)?[\s:|-]*(.*)$"


def read_plain_log(spark: SparkSession, path: str, encoding: str = "UTF-8", after: str | None = None) -> DataFrame:
    """(file, line, time, level, text) of the lines of plain text logs that begin with a time.

    ``after`` resumes behind the newest time that was read (``yyyy-MM-dd HH:mm:ss``). Lines
    without a time belong to no record of their own and are left out.
    """
    lines = spark.read.option("encoding", encoding).option("sep", "\x01").option("quote", "").schema("value string").csv(path)
    part = lambda n: F.regexp_extract("value", _PLAIN, n)
    time = F.try_to_timestamp(F.regexp_replace(part(1), ",", "."))
    out = lines.where(F.col("value").rlike(_PLAIN)).select(F.input_file_name().alias("file"), time.alias("time"), F.nullif(F.upper(part(2)), F.lit("")).alias("level"), part(3).alias("text"))
    return out if after is None else out.where(F.col("time") > F.lit(after).cast("timestamp"))


def script_context(text: Column) -> Column:
    """A map of the ``key=value`` lines of a script event's context."""
    lines = F.filter(F.split(F.regexp_replace(text, "\r", ""), "\n"), lambda x: F.instr(x, "=") > 1)
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), F.trim(F.substring(x, F.instr(x, "=") + 1, F.length(x))).alias("value"))))


def flat(rows: DataFrame) -> DataFrame:
    """Rows with the payload as one JSON column, keys sorted, for row files."""
    shown = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("values"))))
    return rows.select(*[c for c in COMMON if c in rows.columns], shown.alias("values_json"))


def export(rows: DataFrame, path: str, kind: str) -> None:
    """Writes rows as csv, jsonl or xml in files of at most FILE_ROWS rows, times to the microsecond; Spark commits a folder as a whole."""
    exact = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    if kind == "csv":
        flat(rows).write.option("maxRecordsPerFile", FILE_ROWS).option("header", True).option("timestampFormat", exact).option("escape", '"').csv(path)
    elif kind == "jsonl":
        rows.write.option("maxRecordsPerFile", FILE_ROWS).option("timestampFormat", exact).json(path)
    elif kind == "xml":
        flat(rows).write.format("xml").option("maxRecordsPerFile", FILE_ROWS).option("timestampFormat", exact).option("rootTag", "Events").option("rowTag", "Event").save(path)
    else:
        raise ValueError(f"no export {kind!r}")


def export_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of an export's data files, hashed where they are read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changed_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(file, what) of an export's files that are missing, extra or changed since its manifest."""
    now = export_manifest(spark, path).select("file", F.col("sha256").alias("now"))
    both = manifest.select("file", "sha256").join(now, "file", "full")
    what = F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when(F.col("now") != F.col("sha256"), "changed")
    return both.select("file", what.alias("what")).where("what IS NOT NULL")


def report_files(sections: dict[str, DataFrame], path: str) -> dict[str, int]:
    """A CSV folder for each section of a report and a manifest of their rows, counted while they are written."""
    manifest = {}
    for name, rows in sections.items():
        seen = Observation()
        export(rows.observe(seen, F.count(F.lit(1)).alias("rows")), f"{path}/{name}", "csv")
        manifest[name] = seen.get["rows"]
    return manifest


def write_evidence(sections: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes sections as JSON lines under ``path``/data and a manifest (section, file, bytes, sha256) of all files beside them.

    Files are written and hashed by tasks; empty files, which hold no evidence, are not listed. The manifest comes last, so a folder without one was not finished.
    """
    spark = next(iter(sections.values())).sparkSession
    for name, rows in sections.items():
        if not name.replace("_", "").replace("-", "").isalnum():
            raise ValueError(f"section {name!r}")
        rows.write.option("maxRecordsPerFile", FILE_ROWS).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{path}/data/section={name}")
    _evidence_files(spark, path).write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def _evidence_files(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(f"{path}/data")
    at = F.regexp_extract("path", r"/section=([^/]+)/([^/]+)$", 1), F.regexp_extract("path", r"/section=([^/]+)/([^/]+)$", 2)
    return found.select(at[0].alias("section"), at[1].alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_evidence(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """(section, file, what) of evidence files that are missing, extra or changed since their manifest, or that one kept elsewhere."""
    known = (spark.read.parquet(f"{path}/manifest") if manifest is None else manifest).select("section", "file", F.col("sha256").alias("was"))
    both = known.join(_evidence_files(spark, path).select("section", "file", F.col("sha256").alias("now")), ["section", "file"], "full")
    what = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "extra").when(F.col("now") != F.col("was"), "changed")
    return both.select("section", "file", what.alias("what")).where("what IS NOT NULL")


def evidence_bundle(files: dict[str, bytes]) -> bytes:
    """A ZIP of small evidence files with a manifest of their SHA-256 hashes; the same files give the same bytes."""
    out = io.BytesIO()
    manifest = {n: hashlib.sha256(b).hexdigest() for n, b in sorted(files.items())}
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in [*sorted(files.items()), ("manifest.json", json.dumps(manifest, sort_keys=True).encode())]:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def verify_bundle(bundle: bytes) -> list[str]:
    """What is wrong with a bundle: files that are missing, extra or changed."""
    with zipfile.ZipFile(io.BytesIO(bundle)) as z:
        names = set(z.namelist()) - {"manifest.json"}
        manifest = json.loads(z.read("manifest.json"))
        changed = [n for n in names & manifest.keys() if hashlib.sha256(z.read(n)).hexdigest() != manifest[n]]
    return sorted([f"missing {n}" for n in manifest.keys() - names] + [f"extra {n}" for n in names - manifest.keys()] + [f"changed {n}" for n in changed])
