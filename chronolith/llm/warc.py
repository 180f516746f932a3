"""WARC archives with a two-level capture index.

Pages are range-partitioned by capture key (the URL with its host reversed, then page_id),
so an archive holds neighbours of the key order. Each task streams its records to
``.warc.gz`` files, a gzip member a record, and appends the records' index lines, in key
order, to a ``.idx`` file in compressed blocks. The blocks are the lower level of the index;
a ``.dir`` file lists the task's blocks, each with its first and last key and its place. The
upper level is sparse: a row for each task. A look-up binary-searches the rows, the
directory file, the block, and reads one byte range of each file on the way; nothing else.

Many look-ups at once are sorted by key and dealt by range, so a task goes through few
directory files and blocks, keeps the last ones, and reads neighbouring records in one
range. ``op9_warc`` reads every page back so, by its key.

Payloads of at least ``min_bytes`` that several pages share are written once: the page with
the smallest page_id is a ``response``, the others ``revisit`` it without a payload. Which
ones do is found from digests alone; those rows then go along in the shuffle by key that
the pages make anyway, each right before its page, so html is shuffled once.

A task names its files anew at each attempt, and the index comes only from committed
tasks, so files of lost attempts are never read.

Defined cases: null html is an empty payload; a null url sorts first, with an empty
target; a page without page_id is never revisited, and a group of equal payloads without
any page_id is all responses; rows that share the smallest page_id are all responses; an
empty table gives an empty table; columns other than page_id, url and html are not archived.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.shared import kept, open_store, scratch, small_batches

#: Bytes of an archive after which the task begins the next one.
ARCHIVE_BYTES = 1 << 28
#: Records in an index block.
BLOCK_RECORDS = 1_000
#: Fixed values of the format.
VERSION, REVISIT_PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

INDEX_SCHEMA = "directory string, first binary, last binary, n_blocks int, n_records long"
#: Directory files and blocks that a reader keeps, and bytes of neighbouring records that it reads at once.
KEPT_DIRECTORIES, KEPT_BLOCKS, RANGE_BYTES = 16, 16, 1 << 22


def capture_key(url: Column) -> Column:
    """``com,example,www)/path?query`` of a URL; what has no host keeps its text."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "")
    return F.coalesce(F.when(host != "", F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)).otherwise(url), F.lit(""))


def _digest() -> Column:
    return F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)


def revisits(spark: SparkSession, pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """(key, page_id, payload_digest, refers_to) of the pages whose payload another one repeats; no page travels for it, only its digest."""
    size = F.octet_length(F.coalesce("html", F.lit("")))
    big = pages.where(size >= min_bytes).select(capture_key(F.col("url")).alias("key"), F.col("page_id").cast("long"), _digest().alias("payload_digest"))
    big, _ = kept(spark, big, "warc-digests")
    shared = big.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 AND refers_to IS NOT NULL").drop("n")
    return big.join(shared, "payload_digest").where(~F.col("refers_to").eqNullSafe(F.col("page_id"))).select("key", "page_id", "payload_digest", "refers_to")


def _clean(url: str | None) -> str:
    """A URL fit for a header line."""
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in raw.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in line)


def parse(raw: bytes) -> dict:
    """A record's fields; the payload of a response is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _headers(head)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(_headers(http)["Content-Length"])
    number = lambda urn: int(urn[len("<urn:page:") : -1]) if urn and urn != "<urn:page:>" else None
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not match its digest")
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": kind, "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": digest, "refers_to": number(fields.get("WARC-Refers-To"))}


def _place(key: str, page_id: int | None) -> list:
    """What index lines are sorted by; a page without page_id comes first."""
    return [key, page_id is not None, page_id or 0]


def _packed(value) -> bytes:
    return zlib.compress(json.dumps(value).encode(), 6)


def _unpacked(raw: bytes):
    return json.loads(zlib.decompress(raw))


def _archived(batches: Iterator[pa.RecordBatch], folder: str, block_records: int, archive_bytes: int) -> Iterator[pa.RecordBatch]:
    fs, root = open_store(folder)
    task = uuid.uuid4().hex
    out = index = None
    name, at, index_at, archives, records, lines, blocks = "", 0, 0, 0, 0, [], []
    place, told = None, {}

    def close_block() -> None:
        nonlocal index_at
        if lines:
            packed = _packed(lines)
            index.write(packed)
            blocks.append([lines[0][:3], lines[-1][:3], name, index_at, len(packed), len(lines)])
            index_at += len(packed)
            lines.clear()

    for batch in batches:
        for row in batch.to_pylist():
            if place != (row["key"], row["page_id"]):
                place, told = (row["key"], row["page_id"]), {}
            if row["refers_to"] is not None:  # stands before its page
                told[row["payload_digest"]] = row["refers_to"]
                continue
            if out is None or at >= archive_bytes:
                if out is None:
                    fs.create_dir(root, recursive=True)
                    index = fs.open_output_stream(f"{root}/{task}.idx", compression=None)
                else:
                    close_block()
                    out.close()
                name, at, archives = f"{task}-{archives}.warc.gz", 0, archives + 1
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            packer = zlib.compressobj(3, zlib.DEFLATED, 31)
            member = packer.compress(record(row["page_id"], row["url"], (row["html"] or "").encode("utf-8", "surrogatepass"), row["payload_digest"], told.get(row["payload_digest"]))) + packer.flush()
            out.write(member)
            lines.append([*_place(row["key"], row["page_id"]), at, len(member)])
            at += len(member)
            records += 1
            if len(lines) >= block_records:
                close_block()
    if out is None:
        return
    close_block()
    out.close()
    index.close()
    with fs.open_output_stream(f"{root}/{task}.dir", compression=None) as f:
        f.write(_packed(blocks))
    ends = [json.dumps(x).encode() for x in (blocks[0][0], blocks[-1][1])]
    yield pa.RecordBatch.from_arrays([pa.array([task]), pa.array(ends[:1]), pa.array(ends[1:]), pa.array([len(blocks)], pa.int32()), pa.array([records], pa.int64())], names=["directory", "first", "last", "n_blocks", "n_records"])


def write_archives(spark: SparkSession, pages: DataFrame, folder: str | None = None, min_bytes: int = 100, block_records: int = BLOCK_RECORDS, archive_bytes: int = ARCHIVE_BYTES) -> tuple[str, DataFrame]:
    """Archives ``pages`` (page_id, url, html); (folder, the index's upper level, a row for each writing task)."""
    small_batches(spark)
    folder = folder or scratch(spark, "warc")
    key = capture_key(F.col("url"))
    records = pages.select(F.col("page_id").cast("long"), "url", "html", _digest().alias("payload_digest"), F.lit(None).cast("long").alias("refers_to"), key.alias("key"))
    both = records.unionByName(revisits(spark, pages, min_bytes), allowMissingColumns=True)
    columns = both.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", F.col("refers_to").asc_nulls_last())
    index, _ = kept(spark, columns.mapInArrow(lambda it: _archived(it, folder, block_records, archive_bytes), INDEX_SCHEMA), "warc-index")
    return folder, index


def upper_level(index: DataFrame) -> list[tuple[list, list, str]]:
    """(first place, last place, directory) of each writing task, in key order."""
    rows = index.select("first", "last", "directory").collect()  # a row for each task that wrote
    return sorted((json.loads(r["first"]), json.loads(r["last"]), r["directory"]) for r in rows)


def _covering(ranges: list, place: list) -> Iterator[int]:
    """Which of the ranges (first, last, ...), sorted and overlapping at their ends at most, hold a place."""
    at = bisect_right(ranges, place, key=lambda r: r[0]) - 1
    while at >= 0 and ranges[at][1] >= place:
        yield at
        at -= 1


class Reader:
    """Look-ups by place (capture key and page_id): binary searches, and one range read of each file on the way."""

    def __init__(self, folder: str, upper: list[tuple[list, list, str]]):
        self.fs, self.root = open_store(folder)
        self.upper, self.directories, self.blocks = upper, OrderedDict(), OrderedDict()

    def _range(self, name: str, start: int, size: int) -> bytes:
        with self.fs.open_input_file(f"{self.root}/{name}") as f:
            return f.read_at(size, start)

    def _kept(self, held: OrderedDict, key, most: int, load):
        if key in held:
            held.move_to_end(key)
        else:
            held[key] = load()
            while len(held) > most:
                held.popitem(last=False)
        return held[key]

    def _directory(self, task: str) -> list:
        def load():
            with self.fs.open_input_file(f"{self.root}/{task}.dir") as f:
                return _unpacked(f.read())

        return self._kept(self.directories, task, KEPT_DIRECTORIES, load)

    def places(self, place: list) -> list[tuple[str, int, int]]:
        """(file, offset, bytes) of the records at a place; of all records of its key, if it is the key alone."""
        found, whole = [], len(place) == 3
        for i in self._reach(self.upper, place, whole):
            task = self.upper[i][2]
            directory = self._directory(task)
            for j in self._reach(directory, place, whole):
                _, _, name, start, size, _ = directory[j]
                lines = self._kept(self.blocks, (task, start), KEPT_BLOCKS, lambda: _unpacked(self._range(f"{task}.idx", start, size)))  # noqa: B023
                at = bisect_left(lines, place)
                while at < len(lines) and lines[at][: len(place)] == place:
                    found.append((name, lines[at][3], lines[at][4]))
                    at += 1
        return found

    @staticmethod
    def _reach(ranges: list, place: list, whole: bool) -> Iterator[int]:
        """The ranges that hold a place, or any place of a key."""
        if whole:
            yield from _covering(ranges, place)
        else:
            key = place[0]
            at = bisect_right(ranges, key, key=lambda r: r[0][0]) - 1
            while at >= 0 and ranges[at][1][0] >= key:
                yield at
                at -= 1

    def records(self, found: list[tuple[str, int, int]]) -> Iterator[dict]:
        """The records at sorted places; those that lie side by side are read in one range."""
        at = 0
        while at < len(found):
            name, start, size = found[at]
            end = at + 1
            while end < len(found) and found[end][0] == name and found[end][1] == start + size and size < RANGE_BYTES:
                size += found[end][2]
                end += 1
            raw = self._range(name, start, size)
            for _, offset, length in found[at:end]:
                yield parse(zlib.decompress(raw[offset - start : offset - start + length], 31))
            at = end


_FOUND = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}


def _looked_up(batches: Iterator[pa.RecordBatch], folder: str, upper: list) -> Iterator[pa.RecordBatch]:
    reader = Reader(folder, upper)
    for batch in batches:
        found = []
        for key, page_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found += reader.places(_place(key, page_id))
        rows = list(reader.records(found))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], t) for c, t in _FOUND.items()], names=list(_FOUND))


def look_up(spark: SparkSession, folder: str, index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records at the places ``wanted`` (key, page_id): page_id, payload_bytes, payload_digest, record_type, refers_to.

    The upper level goes along with each task: a row for each task that wrote archives.
    """
    upper, blocks = upper_level(index), index.agg(F.coalesce(F.sum("n_blocks"), F.lit(0))).first()[0]
    places = wanted.select("key", F.col("page_id").cast("long")).distinct().repartitionByRange(max(1, min(10_000, -(-blocks // 4))), "key", "page_id").sortWithinPartitions("key", "page_id")
    return places.mapInArrow(lambda it: _looked_up(it, folder, upper), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


class CaptureIndex:
    """Look-ups of single URLs."""

    def __init__(self, folder: str, index: DataFrame):
        self.reader = Reader(folder, upper_level(index))

    def find(self, key: str) -> list[dict]:
        """The records of a capture key, in order of page_id."""
        return sorted(self.reader.records(sorted(self.reader.places([key]))), key=lambda x: (x["page_id"] is not None, x["page_id"]))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder, index = write_archives(spark, pages)
    return look_up(spark, folder, index, pages.select(capture_key(F.col("url")).alias("key"), "page_id"))


ORACLE_SQL = r"""
WITH sized AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), origins AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS origin FROM sized
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN origin <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN origin <> page_id THEN origin END AS refers_to
FROM origins
"""
