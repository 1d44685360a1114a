"""Capture files of any size as splittable input: pcap and pcapng, on every store that Spark reads.

Records are length-prefixed, so a split in the middle of a file has to find its first record. Spark's text source cuts a file
into splits at line feeds and gives each split's bytes back unchanged, a "line" at a time. A split tries each offset until a
chain of plausible record headers follows over more bytes than the largest record has, so that headers inside a payload
can't hold. What stands before its first record and after its last whole one is joined with the neighbouring splits; these
pieces must parse to the byte, else the file is refused. A split too short for such a chain (the last one of a file, as a
rule) is such a piece as a whole. Frame numbers are the splits' record counts summed up.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.schemas import PACKET
from flowspark.sources.pcap import COLUMNS, MAGIC, _packet

#: The largest capture length in use; pcapng block types and the mark of their byte order.
SNAP = 262_144
SECTION, INTERFACE, OLD_PACKET, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 2, 3, 6
BLOCK_TYPES = {SECTION, INTERFACE, OLD_PACKET, SIMPLE, 4, 5, ENHANCED, 7, 8, 9, 10, 0xBAD, 0x40000BAD}
ORDER_MARK = 0x1A2B3C4D

MORE, BAD = -1, -2
KINDS = ((False, "<"), (False, ">"), (True, "<"), (True, ">"))  # (pcapng, byte order)
BATCH = 5_000
CHUNK = 1 << 20


def _next(buf: bytes | bytearray, at: int, kind: tuple[bool, str], strict: bool) -> int:
    """Where the record at ``at`` ends; MORE where bytes are missing, BAD where there can be none."""
    ng, order = kind
    if ng:
        if at + 12 > len(buf):
            return MORE
        what, size = struct.unpack_from(order + "II", buf, at)
        if what == SECTION:
            mark = struct.unpack_from(order + "I", buf, at + 8)[0]
            if mark != ORDER_MARK:
                return BAD
        if size % 4 or not 12 <= size <= 1 << 24 or (strict and what not in BLOCK_TYPES):
            return BAD
        if at + size > len(buf):
            return MORE
        return at + size if struct.unpack_from(order + "I", buf, at + size - 4)[0] == size else BAD
    if at + 16 > len(buf):
        return MORE
    _, fraction, kept, length = struct.unpack_from(order + "IIII", buf, at)
    if kept > 1 << 26 or (strict and not (0 < kept <= min(length, SNAP) and length < 1 << 26 and fraction < 1_000_000_000)):
        return BAD
    return at + 16 + kept if at + 16 + kept <= len(buf) else MORE


def _start(buf: bytes) -> tuple[tuple[bool, str], int] | None:
    """(kind, first record) of a file that begins so; None for no capture."""
    if bytes(buf[:4]) in MAGIC:
        return (False, MAGIC[bytes(buf[:4])][0]), 24
    if len(buf) >= 12 and struct.unpack_from("<I", buf)[0] == SECTION:
        for order in "<>":
            if struct.unpack_from(order + "I", buf, 8)[0] == ORDER_MARK:
                return (True, order), 0
    return None


def _sync(buf: bytes | bytearray) -> tuple[tuple[bool, str], int] | None:
    """The first offset from which a chain of record headers holds for more than SNAP bytes."""
    for at in range(min(len(buf) - SNAP, SNAP + 16)):
        for kind in KINDS:
            here, last = at, None
            while here - at <= SNAP:
                step = _next(buf, here, kind, True)
                if step == BAD:
                    break
                if not kind[0] and here + 4 <= len(buf):
                    second = struct.unpack_from(kind[1] + "I", buf, here)[0]
                    if last is not None and abs(second - last) > 2_592_000:
                        break
                    last = second
                if step == MORE:
                    break
                here = step
            else:
                return kind, at
    return None


def _interface(body: bytes, order: str) -> tuple[int, int]:
    """(link, ticks per second) of an interface block."""
    link, at, ticks = struct.unpack_from(order + "H", body, 8)[0], 16, 1_000_000
    while at + 4 <= len(body) - 4:
        code, size = struct.unpack_from(order + "HH", body, at)
        if code == 0:
            break
        if code == 9 and size >= 1:  # time resolution
            r = body[at + 4]
            ticks = 2 ** (r & 127) if r & 128 else 10**r
        at += 4 + size + (-size) % 4
    return link, ticks


def _record(body: bytes, kind: tuple[bool, str]) -> tuple[int | None, int, int, int, bytes] | None:
    """(interface, ticks or seconds, fraction, length, frame) of a packet record, None for another block."""
    ng, order = kind
    if not ng:
        seconds, fraction, _, length = struct.unpack_from(order + "IIII", body)
        return None, seconds, fraction, length, body[16:]
    what = struct.unpack_from(order + "I", body)[0]
    if what == ENHANCED and len(body) >= 32:
        interface, high, low, kept, length = struct.unpack_from(order + "IIIII", body, 8)
        return interface, (high << 32) | low, 0, length, body[28 : 28 + kept]
    if what == OLD_PACKET and len(body) >= 32:
        interface, _, high, low, kept, length = struct.unpack_from(order + "HHIIII", body, 8)
        return interface, (high << 32) | low, 0, length, body[28 : 28 + kept]
    if what == SIMPLE and len(body) >= 16:
        length = struct.unpack_from(order + "I", body, 8)[0]
        return 0, 0, 0, length, body[12 : 12 + min(length, len(body) - 16)]
    return None


class Split:
    """The records of one split, fed in pieces."""

    def __init__(self, first: bool):
        self.first, self.kind, self.done = first, None, False
        self.buf, self.head, self.setup, self.n = bytearray(), b"", b"", 0

    def feed(self, data: bytes, final: bool) -> Iterator[tuple]:
        self.buf += data
        if self.done:
            self.buf.clear()
            return
        if self.kind is None:
            if not final and len(self.buf) < 4 * SNAP:
                return
            if self.first:
                found = _start(self.buf)
                self.done = found is None
                if found is None:
                    self.buf.clear()
                    return
                self.kind, at = found
                self.setup = bytes(self.buf[:24]) if not self.kind[0] else b""
            else:
                found = _sync(self.buf)
                if found is None:  # no record starts here: all of it belongs to the split before
                    if final:
                        self.head, self.buf = self.head + bytes(self.buf), bytearray()
                    else:
                        self.head += bytes(self.buf[:SNAP])
                        del self.buf[:SNAP]
                    return
                self.kind, at = found
                self.head += bytes(self.buf[:at])
            del self.buf[:at]
        at = 0
        while (end := _next(self.buf, at, self.kind, False)) >= 0:
            body = bytes(self.buf[at:end])
            if self.kind[0] and struct.unpack_from(self.kind[1] + "I", body)[0] in (SECTION, INTERFACE):
                self.setup += body
            row = _record(body, self.kind)
            if row is not None:
                self.n += 1
                yield (self.n, *row)
            at = end
        del self.buf[:at]
        if end == BAD:
            raise ValueError("a capture record has an impossible header")


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(paths)
    return text.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line")
    )


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Split, list[tuple], bool]]:
    """(path, block, split, some of its records, whether these are the last); records come in small lists."""
    now, split, waiting, size = None, None, [], 0

    def flush(final: bool) -> Iterator[tuple]:
        rows = []
        for row in split.feed(b"".join(waiting), final):
            rows.append(row)
            if len(rows) >= BATCH:
                yield (*now, split, rows, False)
                rows = []
        yield (*now, split, rows, final)

    for batch in batches:
        for path, block, line in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "line"))):
            if (path, block) != now:
                if split is not None:
                    yield from flush(True)
                now, split, waiting, size = (path, block), Split(block == 0), [], 0
            waiting += [line, b"\n"]
            size += len(line) + 1
            if size >= CHUNK:
                yield from flush(False)
                waiting, size = [], 0
    if split is not None:
        yield from flush(True)


_META = "path string, block long, n long, ng boolean, byte_order string, setup binary, head binary, tail binary"
_RAW = "path string, block long, no long, interface long, ticks long, fraction long, length long, frame binary"


def _meta(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for path, block, split, _, final in _splits(batches):
        if final:
            ng, order = split.kind or (None, None)
            row = [path, block, split.n, ng, order, split.setup, split.head, bytes(split.buf) if split.kind else b""]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["path", "block", "n", "ng", "byte_order", "setup", "head", "tail"])


def _batch(path: str, block: int, rows: list[tuple]) -> pa.RecordBatch:
    n, columns = len(rows), list(zip(*rows))
    kinds = [pa.int64()] * 5 + [pa.binary()]
    ends = [pa.array([path] * n, pa.string()), pa.array([block] * n, pa.int64())]
    return pa.RecordBatch.from_arrays([*ends, *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["path", "block", "no", "interface", "ticks", "fraction", "length", "frame"])


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for path, block, _, rows, _ in _splits(batches):
        if rows:
            yield _batch(path, block, rows)


def _seams(group: pd.DataFrame) -> pd.DataFrame:
    """Of one file: what its splits begin with (offset of frame numbers, links) and the records that lie across splits.

    Only the ends of splits and their counts come here, not the records.
    """
    group = group.sort_values("block")
    first = group.iloc[0]
    out, kind = [], None
    links: list[tuple[int, int]] = []
    if first["byte_order"] is not None and first["block"] == 0:
        kind = (bool(first["ng"]), first["byte_order"])
        if not kind[0]:
            head = bytes(first["setup"])
            links = [(struct.unpack_from(kind[1] + "I", head, 20)[0] & 0x0FFFFFFF, MAGIC[head[:4]][1])]

    def add_links(setup: bytes) -> None:
        at = 0
        while kind[0] and at < len(setup):
            end = _next(setup, at, kind, False)
            if struct.unpack_from(kind[1] + "I", setup, at)[0] == INTERFACE:
                links.append(_interface(setup[at:end], kind[1]))
            at = end

    offset, waiting = 0, b""
    for i, s in enumerate(group.itertuples()):
        if kind is None:
            break
        if i:
            waiting += bytes(s.head)
            if s.byte_order is not None:
                at = 0
                while (end := _next(waiting, at, kind, False)) >= 0:
                    body = waiting[at:end]
                    if kind[0]:
                        add_links(body if struct.unpack_from(kind[1] + "I", body)[0] == INTERFACE else b"")
                    row = _record(body, kind)
                    if row is not None:
                        offset += 1
                        out.append((s.path, None, offset, None, None, *row))
                    at = end
                if at != len(waiting) or (bool(s.ng), s.byte_order) != kind:
                    raise ValueError(f"no whole records between two splits of {s.path}, byte {s.block}")
                waiting = b""
            else:
                continue
        add_links(bytes(s.setup) if kind[0] else b"")
        out.append((s.path, s.block, offset, None, None, None, None, None, None, None))
        offset += int(s.n)
        waiting = bytes(s.tail)
    at = 0
    while kind is not None and len(group) > 1 and (end := _next(waiting, at, kind, False)) >= 0:
        row = _record(waiting[at:end], kind)
        if row is not None:
            offset += 1
            out.append((group.iloc[0]["path"], None, offset, None, None, *row))
        at = end
    names = ["path", "block", "at", "link_ids", "link_ticks", "interface", "ticks", "fraction", "length", "frame"]
    done = pd.DataFrame(out, columns=names)
    done["link_ids"] = pd.Series([[a for a, _ in links]] * len(done), dtype=object)
    done["link_ticks"] = pd.Series([[b for _, b in links]] * len(done), dtype=object)
    for c in ("block", "at", "interface", "ticks", "fraction", "length"):
        done[c] = done[c].astype("Int64")
    return done


_SEAM = "path string, block long, at long, link_ids array<long>, link_ticks array<long>, interface long, ticks long, fraction long, length long, frame binary"


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, number, ids, per, interface, ticks, fraction, length, frame in zip(
            *(batch[c] for c in ("path", "packet_number", "link_ids", "link_ticks", "interface", "ticks", "fraction", "length", "frame"))
        ):
            i = 0 if pd.isna(interface) else int(interface)
            if i >= len(ids):
                continue
            found = _packet(bytes(frame), int(ids[i]))
            if found is None:
                continue
            second = 1_000_000
            us = int(ticks) * second + int(fraction) * second // int(per[i]) if pd.isna(interface) else int(ticks) * second // int(per[i])
            src, dst, sport, dport, proto, payload, flags, window, size = found
            rows.append((us, src, dst, sport, dport, proto, int(length), payload, path, int(number), flags, window, size))
        out = pd.DataFrame(rows, columns=COLUMNS)
        for c in ("tcp_flags", "window"):
            out[c] = out[c].astype("Int32")
        yield out


def read_captures(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Packets of pcap and pcapng files: TCP and UDP over IPv4 or IPv6; frames count from 1 per file.

    Files are read in splits of ``spark.sql.files.maxPartitionBytes``, twice (once for counts and ends of splits); their
    size has no limit. Splits should have a megabyte at least: shorter ones are put together by one task a file. Other files give no packets, a record cut off at the end of a file is left out. In pcapng the
    interfaces of all sections of a file are numbered on; a simple packet has time 0.
    """
    lines = _lines(spark, paths)
    seams = lines.mapInArrow(_meta, _META).groupBy("path").applyInPandas(_seams, _SEAM)
    places = seams.filter("block is not null").select("path", "block", "at", "link_ids", "link_ticks")
    own = lines.mapInArrow(_raw, _RAW).join(places, ["path", "block"])
    fields = ["link_ids", "link_ticks", "interface", "ticks", "fraction", "length", "frame"]
    whole = own.select("path", (F.col("at") + F.col("no")).alias("packet_number"), *fields)
    across = seams.filter("block is null").select("path", F.col("at").alias("packet_number"), *fields)
    return whole.unionByName(across).mapInPandas(_decode, PACKET)
