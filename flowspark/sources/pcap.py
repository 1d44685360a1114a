"""Packets of capture records, and of whole small captures that stand in a column."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from flowspark.schemas import PACKET

BATCH = 10_000
PAYLOAD = 1024
# fixed values: file magic to (byte order, ticks per second), and the link types read
MAGIC = {
    b"\xa1\xb2\xc3\xd4": (">", 1_000_000),
    b"\xd4\xc3\xb2\xa1": ("<", 1_000_000),
    b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000),
    b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000),
}
ETHERNET_LINK, RAW_LINK = 1, 101


def records(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """``(ts_us, original length, captured bytes)`` of each record; a cut last record is left out."""
    if data[:4] not in MAGIC:
        return
    order, ticks = MAGIC[data[:4]]
    at = 24
    while at + 16 <= len(data):
        secs, frac, kept, length = struct.unpack_from(order + "IIII", data, at)
        at += 16
        if at + kept > len(data):
            return
        yield secs * 1_000_000 + frac * 1_000_000 // ticks, length, data[at : at + kept]
        at += kept


def _address(raw: bytes) -> str:
    if len(raw) == 4:
        return ".".join(map(str, raw))
    import ipaddress

    return str(ipaddress.IPv6Address(raw))


def _packet(frame: bytes, link: int) -> tuple | None:
    """Addresses, ports, protocol, payload, flags, window and payload size, or None."""
    if link == ETHERNET_LINK:
        kind, ip = int.from_bytes(frame[12:14], "big"), frame[14:]
        if kind == 0x8100:  # one VLAN tag
            kind, ip = int.from_bytes(frame[16:18], "big"), frame[18:]
    else:
        ip = frame
        kind = {4: 0x0800, 6: 0x86DD}.get(ip[0] >> 4 if ip else 0, 0)
    if kind == 0x0800 and len(ip) >= 20 and ip[0] >> 4 == 4:
        head, proto, src, dst = (ip[0] & 15) * 4, ip[9], ip[12:16], ip[16:20]
        end = int.from_bytes(ip[2:4], "big") or len(ip)
    elif kind == 0x86DD and len(ip) >= 40:
        head, proto, src, dst = 40, ip[6], ip[8:24], ip[24:40]
        end = 40 + int.from_bytes(ip[4:6], "big")
    else:
        return None
    body = ip[head:end]
    if proto == 6 and len(body) >= 20:
        skip, flags, window = (body[12] >> 4) * 4, body[13], int.from_bytes(body[14:16], "big")
    elif proto == 17 and len(body) >= 8:
        skip, flags, window = 8, None, None
    else:
        return None
    payload = body[skip:]
    ports = struct.unpack_from(">HH", body)
    return _address(src), _address(dst), *ports, proto, payload[:PAYLOAD], flags, window, len(payload)


COLUMNS = [c.split()[0] for c in PACKET.split(",")]


def _read_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, data in zip(batch["path"], batch["content"], strict=True):
            order, _ = MAGIC.get(data[:4], ("<", 0))
            link = struct.unpack_from(order + "I", data, 20)[0] if len(data) >= 24 else 0
            rows = []
            for number, (ts_us, length, frame) in enumerate(records(data), start=1):
                found = _packet(frame, link)
                if found is None:
                    continue
                src, dst, sport, dport, proto, payload, flags, window, size = found
                rows.append((ts_us, src, dst, sport, dport, proto, length, payload, path, number, flags, window, size))
                if len(rows) >= BATCH:
                    yield _frame(rows)
                    rows = []
            if rows:
                yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=COLUMNS)
    for c in ("tcp_flags", "window"):
        out[c] = out[c].astype("Int32")
    return out


def decode_pcap(files: DataFrame) -> DataFrame:
    """Packets of whole captures given as ``path, content``, one task's work each; ``read_pcap`` splits files."""
    return files.select("path", "content").mapInPandas(_read_files, PACKET)


def read_pcap(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Packets of every capture file of any size (see ``captures``)."""
    from flowspark.sources.captures import read_captures

    return read_captures(spark, paths)
