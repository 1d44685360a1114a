"""Growing files as streams that resume: log lines by byte offset, captures by byte offset and packet number.

The offset of a stream is the place reached in every file of the folder, kept in the query's checkpoint; it grows with the
number of files. A batch takes at most ``maxBytesPerTrigger`` of each file, up to the last whole line or record; the driver
looks at line ends and record headers only. Files are opened in the tasks by pyarrow's file systems (local or mounted paths,
and the stores it knows), since a Python source has no other way to a file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from flowspark.schemas import PACKET
from flowspark.sources import captures as C
from flowspark.sources.pcap import MAGIC, _packet
from flowspark.sources.zeek import header_fields, parse_zeek_lines

STEP = 64 << 20
HEAD = 1 << 16


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> dict[str, int]:
    """Files of a folder (or the one file) and their sizes."""
    from pyarrow import fs

    store, where = _store(path)
    info = store.get_file_info(where)
    if info.type == fs.FileType.File:
        return {where: info.size}
    found = store.get_file_info(fs.FileSelector(where, allow_not_found=True))
    return {f.path: f.size for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))}


def _read(path: str, name: str, start: int, size: int) -> bytes:
    store, _ = _store(path)
    with store.open_input_file(name) as f:
        f.seek(start)
        return f.read(size)


class Range(InputPartition):
    def __init__(self, name: str, start: int, end: int, number: int = 0):
        self.name, self.start, self.end, self.number = name, start, end, number


class _Follower(DataSourceStreamReader):
    """Offsets are {file: place}; ``end_of`` tells how far a file can be read from a place."""

    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("maxBytesPerTrigger", STEP))
        self.reached: dict = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        now = dict(self.reached)
        for name, size in sorted(_files(self.path).items()):
            now[name] = self.end_of(name, now.get(name), size)
        self.reached = now
        return now

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.reached = dict(end)  # after a restart: go on from there
        return [r for name, place in sorted(end.items()) for r in self.ranges(name, start.get(name), place)]

    def commit(self, end: dict) -> None:
        pass


class LineFollower(_Follower):
    def end_of(self, name: str, place: int | None, size: int) -> int:
        start = place or 0
        window = self.step
        while True:  # a line longer than a step is taken whole
            stop = min(size, start + window)
            if stop <= start:
                return start
            last = _read(self.path, name, start, stop - start).rfind(b"\n")
            if last >= 0 or stop == size:
                return start + last + 1
            window *= 2

    def ranges(self, name: str, start: int | None, end: int) -> list[Range]:
        return [Range(name, start or 0, end)] if end > (start or 0) else []

    def read(self, partition: Range) -> Iterator[tuple]:
        data = _read(self.path, partition.name, partition.start, partition.end - partition.start)
        head = _read(self.path, partition.name, 0, HEAD).split(b"\n")
        header = next((x.decode("utf-8", "replace") for x in head if x.startswith(b"#fields")), None)
        at = partition.start
        for line in data.split(b"\n")[:-1]:
            yield partition.name, at, line.decode("utf-8", "replace"), header
            at += len(line) + 1


class FollowLines(DataSource):
    """Whole lines of growing text files: (file_path, at, line, header), ``at`` the byte at which the line starts."""

    @classmethod
    def name(cls) -> str:
        return "follow_lines"

    def schema(self) -> str:
        return "file_path string, at long, line string, header_line string"

    def streamReader(self, schema) -> LineFollower:
        return LineFollower(self.options)


class CaptureFollower(_Follower):
    def _kind(self, name: str):
        return C._start(_read(self.path, name, 0, 24))

    def end_of(self, name: str, place: list[int] | None, size: int) -> list[int]:
        found = self._kind(name) if size >= 24 else None
        if found is None:
            return place or [0, 0]
        kind, first = found
        at, number = place if place and place[0] else (first, 0)
        data = _read(self.path, name, at, min(self.step, size - at))
        here = 0
        while (end := C._next(data, here, kind, False)) >= 0:
            number += C._record(data[here:end], kind) is not None
            here = end
        if end == C.BAD:
            raise ValueError(f"{name} holds no capture record at byte {at + here}")
        return [at + here, number]

    def ranges(self, name: str, start: list[int] | None, end: list[int]) -> list[Range]:
        at, number = start or [0, 0]
        return [Range(name, at, end[0], number)] if end[0] > at else []

    def read(self, partition: Range) -> Iterator[tuple]:
        kind, first = self._kind(partition.name)
        links = []
        if not kind[0]:
            head = _read(self.path, partition.name, 0, 24)
            links = [(struct.unpack_from(kind[1] + "I", head, 20)[0] & 0x0FFFFFFF, MAGIC[head[:4]][1])]
        start = max(partition.start, first)
        if kind[0] and start > first:  # interfaces told before the place
            links += self._interfaces(_read(self.path, partition.name, first, min(start - first, HEAD)), kind)
        data, at, number = _read(self.path, partition.name, start, partition.end - start), 0, partition.number
        while (end := C._next(data, at, kind, False)) >= 0:
            body = data[at:end]
            at = end
            links += self._interfaces(body, kind) if kind[0] else []
            row = C._record(body, kind)
            if row is None:
                continue
            number += 1
            interface, ticks, fraction, length, frame = row
            if (interface or 0) >= len(links):
                continue
            link, per = links[interface or 0]
            found = _packet(frame, link)
            if found is not None:
                us = ticks * 1_000_000 + fraction * 1_000_000 // per if interface is None else ticks * 1_000_000 // per
                src, dst, sport, dport, proto, payload, flags, window, size = found
                yield us, src, dst, sport, dport, proto, length, payload, partition.name, number, flags, window, size

    @staticmethod
    def _interfaces(data: bytes, kind: tuple[bool, str]) -> list[tuple[int, int]]:
        out, at = [], 0
        while (end := C._next(data, at, kind, False)) >= 0:
            if struct.unpack_from(kind[1] + "I", data, at)[0] == C.INTERFACE:
                out.append(C._interface(data[at:end], kind[1]))
            at = end
        return out


class FollowCaptures(DataSource):
    """Packets of growing captures, as ``read_captures`` gives them."""

    @classmethod
    def name(cls) -> str:
        return "follow_captures"

    def schema(self) -> str:
        return PACKET

    def streamReader(self, schema) -> CaptureFollower:
        return CaptureFollower(self.options)


def stream_captures(spark: SparkSession, path: str, max_bytes: int = STEP) -> DataFrame:
    """Packets of the captures in a folder as they grow; each record once, also over restarts from a checkpoint.

    Of a pcapng file the interfaces must stand in its first 64 KiB or in the part that is read.
    """
    spark.dataSource.register(FollowCaptures)
    return spark.readStream.format("follow_captures").option("path", path).option("maxBytesPerTrigger", max_bytes).load()


def stream_zeek(spark: SparkSession, path: str, max_bytes: int = STEP) -> DataFrame:
    """Records of the protocol logs in a folder as they grow: (log_type, fields_raw, raw_line, file_path, at).

    Lines before a file's ``#fields`` line, and files without one in their first 64 KiB, give no records.
    """
    spark.dataSource.register(FollowLines)
    lines = spark.readStream.format("follow_lines").option("path", path).option("maxBytesPerTrigger", max_bytes).load()
    named = lines.filter("header_line is not null").withColumn("header", header_fields("header_line"))
    return parse_zeek_lines(named).select("log_type", "fields_raw", F.col("line").alias("raw_line"), "file_path", "at")
