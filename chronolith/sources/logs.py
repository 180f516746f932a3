"""A Spark data source for diagnostic text logs: ``spark.read.format("chronolith_log")`` and ``readStream``.

A record begins at a line that starts with a time, or with ``<![LOG[``, and takes the lines behind it up to the
next one. Files are cut into byte ranges; a range gives the records that begin in it, so
any cut gives the same records. The encoding is found by the byte order mark (UTF-16 of either
order, else UTF-8).

A stream's offset holds for each file how far it was read, with hashes of its first and of
the last bytes before that place. A file that only grew goes on there; one that was
replaced is read anew, which its first record says. A stream leaves a file's last record alone until another
begins behind it, as lines may still come; with the option ``final`` it takes it.

Options: path (a file or folder), range_bytes, record_bytes (a longer record is cut and says so),
final. A filter on ``file`` (equal, in) leaves files out before they are opened. Files are reached through their file system by each task.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

SCHEMA = "file string, generation string, byte_start long, byte_end long, time timestamp, level string, text string, diagnostic string"
#: Bytes whose hashes tell a file that grew from one that was replaced.
EDGE = 4_096
_MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
_START = re.compile(r"\s*(?:<!\[LOG\[|\[?(\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d)(?:[.,](\d{1,6})\d*)?(Z|[+-]\d\d:?\d\d)?\]?\s*(?:[:|-]?\s*\[?(TRACE|DEBUG|INFO|INFORMATION|WARN|WARNING|ERROR|FATAL|CRITICAL)\b\]?)?[\s:|-]*)", re.IGNORECASE)
_FRAME = re.compile(r'\s*<!\[LOG\[(.*?)\]LOG\]!>(?:<time="(\d\d:\d\d:\d\d)\.(\d+)([+-]\d+)?" date="(\d\d?)-(\d\d?)-(\d{4})")?', re.DOTALL)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(path))


def _files(path: str) -> list[tuple[str, int]]:
    """(path, size) of the log files below a path, in order."""
    store, at = _open(path)
    info = store.get_file_info(at)
    found = [info] if info.is_file else store.get_file_info(pafs.FileSelector(at, recursive=True))
    named = lambda f: not f.path.rpartition("/")[2].startswith(("_", "."))
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    return sorted((prefix + f.path, f.size) for f in found if f.is_file and named(f))


class LogFile:
    """A file's bytes by place, its encoding, and its lines."""

    def __init__(self, path: str):
        store, at = _open(path)
        self.path, self.source = path, store.open_input_file(at)
        self.size = self.source.size()
        head = self.read(0, 4)
        mark, self.encoding = next(((m, e) for m, e in _MARKS if head.startswith(m)), (b"", "utf-8"))
        self.begin, self.newline = len(mark), "\n".encode(self.encoding)

    def read(self, start: int, n: int) -> bytes:
        self.source.seek(start)
        return self.source.read(max(0, min(n, self.size - start)))

    def edge(self, end: int) -> str:
        start = max(0, end - EDGE)
        return hashlib.sha256(self.read(start, end - start)).hexdigest()

    def generation(self, length: int) -> str:
        return hashlib.sha256(self.read(0, length)).hexdigest()[:16]

    def lines(self, start: int, block: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
        """(place, bytes) of the lines from a place on that begins one."""
        held, place, unit = b"", start, len(self.newline)
        while True:
            more = self.read(place + len(held), block)
            held += more
            at = 0
            while (end := self._line_end(held, at)) is not None:
                yield place + at, held[at:end]
                at = end
            held, place = held[at:], place + at
            if not more:
                if len(held) >= unit:
                    yield place, held
                return

    def _line_end(self, held: bytes, at: int) -> int | None:
        unit, end = len(self.newline), held.find(self.newline, at)
        while end >= 0 and (end - at) % unit:  # half of one letter and half of the next
            end = held.find(self.newline, end + 1)
        return None if end < 0 else end + unit

    def first_line(self, start: int) -> int:
        """Where the first line at or behind ``start`` begins."""
        if start <= self.begin:
            return self.begin
        unit = len(self.newline)
        place = start - (start - self.begin) % unit - unit  # a line feed right before start counts
        while True:
            block = self.read(place, 1 << 16)
            end = self._line_end(block, 0)
            if end is not None:
                found = place + end
                return found if found >= start else self.first_line_behind(found, start)
            if place + len(block) >= self.size:
                return self.size
            place += len(block) - len(block) % unit

    def first_line_behind(self, place: int, start: int) -> int:
        for at, _ in self.lines(place):
            if at >= start:
                return at
        return self.size

    def last_start(self, least: int, record_bytes: int) -> int:
        """Where the last record that may still grow begins; ``least`` if none is found behind it."""
        found = least
        for place, line in self.lines(self.first_line(max(least, self.size - record_bytes))):
            if line.endswith(self.newline) and _START.match(line.decode(self.encoding, "replace")):
                found = place
        return found

    def records(self, start: int, end: int, record_bytes: int, until: int | None = None) -> Iterator[tuple[int, int, str, str | None]]:
        """(begin, end, text, diagnostic) of the records that begin in [start, end); none reaches behind ``until``."""
        begin, parts, held, place = None, [], 0, start
        for place, line in self.lines(self.first_line(start)):
            if until is not None and place >= until:
                break
            starts = _START.match(line.decode(self.encoding, "replace"))
            if starts or begin is None and place == self.begin:
                if begin is not None:
                    yield self._record(begin, place, parts, held, record_bytes)
                if place >= end:
                    return
                begin, parts, held = place, [], 0
            if begin is not None:
                if held < record_bytes:
                    parts.append(line)
                held += len(line)
        else:
            place = self.size
        if begin is not None:
            yield self._record(begin, place, parts, held, record_bytes)

    def _record(self, begin: int, end: int, parts: list[bytes], held: int, most: int) -> tuple[int, int, str, str | None]:
        raw = b"".join(parts)[: most - most % len(self.newline)]
        try:
            return begin, end, raw.decode(self.encoding), "Oversized" if held > most else None
        except UnicodeDecodeError:
            return begin, end, raw.decode(self.encoding, "replace"), "Oversized" if held > most else "Malformed"


def parsed(text: str) -> tuple[datetime | None, str | None, str]:
    """(time in UTC, level, text) of a record; a time without a zone is UTC."""
    text = text.rstrip("\r\n")
    frame = _FRAME.match(text)
    if frame:
        body, clock, part, bias, month, day, year = frame.groups()
        if clock is None:
            return None, None, body
        stamp = datetime.fromisoformat(f"{year}-{int(month):02d}-{int(day):02d}T{clock}.{part[:6]:0<6}+00:00")
        return datetime.fromtimestamp(stamp.timestamp() + 60 * int(bias or 0), timezone.utc), None, body
    m = _START.match(text)
    if not m or m[1] is None:
        return None, None, text
    zone = m[3] or "Z"
    try:
        at = datetime.fromisoformat(m[1].replace(" ", "T") + f".{(m[2] or '0'):0<6}" + ("+00:00" if zone in "Zz" else zone)).astimezone(timezone.utc)
    except ValueError:
        return None, None, text
    return at, m[4] and m[4].upper(), text[m.end() :]


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int
    until: int | None
    generation: str
    diagnostic: str | None = None


class _Reading:
    """What batch and stream readers share."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.range_bytes, self.record_bytes = int(options.get("range_bytes", 64 << 20)), int(options.get("record_bytes", 1 << 20))
        self.final = str(options.get("final", "false")).lower() == "true"

    def cut(self, file: str, start: int, end: int, until: int | None, generation: str, diagnostic: str | None = None) -> list[Range]:
        return [Range(file, at, min(end, at + self.range_bytes), until, generation, diagnostic if at == start else None) for at in range(start, end, self.range_bytes)]

    def read(self, part: Range) -> Iterator[tuple]:
        log, said = LogFile(part.file), part.diagnostic
        for begin, end, text, wrong in log.records(part.start, part.end, self.record_bytes, part.until):
            at, level, body = parsed(text)
            notes = [x for x in (said, wrong) if x]
            yield part.file, part.generation, begin, end, at, level, body, "; ".join(notes) or None
            said = None


class LogReader(_Reading, DataSourceReader):
    """The whole of every file."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.only: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("file",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = named if self.only is None else self.only & named
            else:
                yield f

    def partitions(self) -> Sequence[Range]:
        out = []
        for file, size in _files(self.path):
            if self.only is None or file in self.only:
                out += self.cut(file, 0, size, None, LogFile(file).generation(min(size, EDGE)))
        return out


class LogStream(_Reading, DataSourceStreamReader):
    """What each file gained since the last offset."""

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        seen = {}
        for file, size in _files(self.path):
            log = LogFile(file)
            end = log.size if self.final else log.last_start(log.begin, self.record_bytes)
            if end > log.begin:
                head = min(end, EDGE)
                seen[file] = [end, head, log.generation(head), log.edge(end)]
        return {"files": json.dumps(seen, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> Sequence[Range]:
        was, now, out = json.loads(start["files"]), json.loads(end["files"]), []
        for file, (until, head, generation, _) in sorted(now.items()):
            begin, said = 0, None
            if file in was:
                old_end, old_head, old_generation, old_edge = was[file]
                log = LogFile(file)
                if old_end <= until and log.generation(old_head) == old_generation and log.edge(old_end) == old_edge:
                    begin = old_end
                else:
                    said = "The file was replaced; it is read from its beginning."
            out += self.cut(file, begin, until, until, generation, said)
        return out

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chronolith_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> LogStream:
        return LogStream(self.options)


def register(spark: SparkSession) -> None:
    """Makes ``format("chronolith_log")`` known to the session, and lets it see filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LogSource)
