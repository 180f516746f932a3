"""The log data source: any cut gives the same records, encodings, appended and replaced files."""

from datetime import datetime

import pytest

from chronolith.sources import logs

LOG = "orphan line\n2024-01-01 00:00:01 [ERROR] first\n  more of it\n\n2024-01-01T00:00:02.5Z warn: second é𝄞\n[2024-01-01 02:00:03,25+02:00] third\n2024-99-01 00:00:00 no time\n"
WANT = [(None, None, "orphan line"), ("00:00:01", "ERROR", "first\n  more of it"), ("00:00:02.500000", "WARN", "second é𝄞"), ("00:00:03.250000", None, "third"), (None, None, "2024-99-01 00:00:00 no time")]


def shown(rows):
    return [(r["time"] and str(r["time"])[11:], r["level"], r["text"]) for r in sorted(rows, key=lambda r: (r["file"], r["byte_start"]))]


@pytest.fixture
def source(spark):
    logs.register(spark)


@pytest.mark.parametrize("encoding, mark", [("utf-8", b""), ("utf-8", b"\xef\xbb\xbf"), ("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff")])
@pytest.mark.parametrize("range_bytes", [1 << 20, 64, 7, 1])
def test_records_do_not_depend_on_the_cut(tmp_path, encoding, mark, range_bytes):
    file = tmp_path / "a.log"
    file.write_bytes(mark + LOG.replace("\n", "\r\n", 1).encode(encoding))
    reader = logs.LogReader({"path": str(tmp_path), "range_bytes": str(range_bytes)})
    rows = [dict(zip([c.split()[0] for c in logs.SCHEMA.split(", ")], r)) for p in reader.partitions() for r in reader.read(p)]
    assert [(r["time"] and r["time"].strftime("%H:%M:%S.%f").removesuffix(".000000"), r["level"], r["text"]) for r in rows] == WANT
    assert [r["byte_start"] for r in rows][1:] == [r["byte_end"] for r in rows][:-1] and rows[-1]["byte_end"] == file.stat().st_size


def test_letters_that_hold_a_line_feed_byte_do_not_end_a_line(tmp_path):
    (tmp_path / "a.log").write_bytes(b"\xff\xfe" + "2024-01-01 00:00:01 \u0a0a\u0a00\u000a\u010a x\n".encode("utf-16-le"))
    reader = logs.LogReader({"path": str(tmp_path), "range_bytes": "3"})
    assert [r[6] for p in reader.partitions() for r in reader.read(p)] == ["\u0a0a\u0a00\n\u010a x"]


def test_batch_frames_bounds_and_pruned_files(spark, source, tmp_path):
    (tmp_path / "f.log").write_text('<![LOG[over\ntwo lines]LOG]!><time="10:00:00.123-60" date="01-02-2024" component="c" context="" type="1" thread="2">\n2024-01-01 00:00:01 ' + "x" * 500 + "\n")
    (tmp_path / "g.log").write_bytes(b"2024-01-01 00:00:05 bad \xff byte\n")
    (tmp_path / "_hidden").write_text("2024-01-01 00:00:01 no\n")
    (tmp_path / "empty.log").write_text("")
    got = spark.read.format("chronolith_log").option("path", str(tmp_path)).option("record_bytes", 200).load().collect()
    rows = sorted(got, key=lambda r: (r["file"], r["byte_start"]))
    assert [(r["text"][:9], r["diagnostic"]) for r in rows] == [("over\ntwo ", None), ("x" * 9, "Oversized"), ("bad \ufffd byt", "Malformed")]
    assert rows[0]["time"] == datetime(2024, 1, 2, 9, 0, 0, 123000)
    reader = logs.LogReader({"path": str(tmp_path)})
    assert list(reader.pushFilters([logs.EqualTo(("file",), f"{tmp_path}/g.log"), logs.EqualTo(("level",), "x")])) == [logs.EqualTo(("level",), "x")]
    assert [p.file for p in reader.partitions()] == [f"{tmp_path}/g.log"]


def test_a_stream_gives_each_record_once_and_sees_replaced_files(spark, source, tmp_path):
    log, out = tmp_path / "in" / "a.log", tmp_path / "out"
    log.parent.mkdir()

    def run(**options):
        rows = spark.readStream.format("chronolith_log").option("path", str(log.parent)).options(**options).load()
        rows.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
        return shown(spark.read.schema(logs.SCHEMA).parquet(str(out)).collect())

    log.write_text("2024-01-01 00:00:01 one\n2024-01-01 00:00:01 two\n")
    assert [t for _, _, t in run()] == ["one"]  # the second may still grow
    with log.open("a") as f:
        f.write(" goes on\n2024-01-01 00:00:01 three\n2024-01-01 00:00:02 fo")
    assert [t for _, _, t in run()] == ["one", "two\n goes on"]
    with log.open("a") as f:
        f.write("ur\n")
    assert [t for _, _, t in run(final=True)] == ["one", "two\n goes on", "three", "four"]
    log.write_text("2024-01-02 00:00:01 new\n2024-01-02 00:00:02 file\n" * 40)
    run(final=True)
    rows = spark.read.schema(logs.SCHEMA).parquet(str(out)).collect()
    assert len(rows) == 84 and [r["text"] for r in rows if r["diagnostic"]] == ["new"] and len({r["generation"] for r in rows}) >= 2
