"""Captures read over many splits equal a whole read."""

import random
import struct

import pytest

from flowspark.sources import captures, pcap

SHOWN = ["packet_number", "ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "payload", "length", "payload_len"]


def frame(rng, i):
    proto = rng.choice([6, 17])
    body = rng.choice([b"\0" * 900, rng.randbytes(rng.randrange(1, 1200)), b"\n" * 50, b""])
    if i % 50 == 7:  # records inside a payload
        body = b"".join(struct.pack("<IIII", 1000 + j, 5, 20, 20) + b"\n" * 20 for j in range(20))
    if proto == 6:
        body = struct.pack(">HHIIBBHHH", i % 60000, 80, 0, 0, 5 << 4, 0x12, 512, 0, 0) + body
    else:
        body = struct.pack(">HHHH", i % 60000, 53, 8 + len(body), 0) + body
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, 64, proto, 0, b"\x0a\0\0\1", b"\x0a\0\0\2") + body
    return b"\xaa" * 12 + b"\x08\0" + ip if i % 9 else b"junk"


def pcap_bytes(n, order="<", seed=1, magic=b"\xd4\xc3\xb2\xa1"):
    rng = random.Random(seed)
    out = [magic + struct.pack(order + "HHiIII", 2, 4, 0, 0, 262144, 1)]
    for i in range(n):
        f = frame(rng, i)
        out.append(struct.pack(order + "IIII", 1_700_000_000 + i // 10, i % 10**6, len(f), len(f)) + f)
    return b"".join(out)


def block(order, what, body):
    body += b"\0" * (-len(body) % 4)
    return struct.pack(order + "II", what, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)


def pcapng_bytes(n, order="<", seed=1):
    rng = random.Random(seed)
    out = [block(order, 0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1)), block(order, 1, struct.pack(order + "HHI", 1, 0, 0)),
           block(order, 1, struct.pack(order + "HHI", 1, 0, 0) + struct.pack(order + "HHB3x", 9, 1, 9) + struct.pack(order + "HH", 0, 0))]
    for i in range(n):
        f = frame(rng, i)
        us = (1_700_000_000 + i // 10) * 10**6 + i % 10**6
        ticks = us * 1000 if i % 3 == 0 else us
        out.append(block(order, 6, struct.pack(order + "IIIII", int(i % 3 == 0), ticks >> 32, ticks & 0xFFFFFFFF, len(f), len(f)) + f))
        if i % 40 == 0:
            out.append(block(order, 5, b"\0" * 16))
    return b"".join(out)


def whole(spark, path):
    return pcap.decode_pcap(spark.read.format("binaryFile").load(path))


def read(spark, path, size):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        df = captures.read_captures(spark, path)
        return sorted(tuple(r) for r in df.select(*SHOWN).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("order,magic", [("<", b"\xd4\xc3\xb2\xa1"), (">", b"\xa1\xb2\xc3\xd4")])
def test_pcap_over_splits(spark, tmp_path, order, magic):
    data = pcap_bytes(14_000, order, magic=magic)
    (tmp_path / "a.pcap").write_bytes(data + b"\0" * 7)
    want = sorted(tuple(r) for r in whole(spark, str(tmp_path / "a.pcap")).select(*SHOWN).collect())
    assert len(want) > 12_000 and len(data) > 4 * 1_200_000
    assert read(spark, str(tmp_path), 1_200_000) == want
    assert read(spark, str(tmp_path), 100_000) == want
    assert read(spark, str(tmp_path), 10**9) == want


@pytest.mark.parametrize("order", "<>")
def test_pcapng_over_splits(spark, tmp_path, order):
    (tmp_path / "a.pcapng").write_bytes(pcapng_bytes(9000, order))
    (tmp_path / "b.pcap").write_bytes(pcap_bytes(9000))
    want = sorted(tuple(r) for r in whole(spark, str(tmp_path / "b.pcap")).select(*SHOWN).collect())
    assert read(spark, str(tmp_path / "a.pcapng"), 1_100_000) == want
    assert read(spark, [str(tmp_path / "a.pcapng"), str(tmp_path / "b.pcap")], 1_500_000) == sorted(want + want)


def test_other_files(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"text\n" * 5)
    (tmp_path / "b").write_bytes(b"")
    (tmp_path / "c").write_bytes(pcap_bytes(0))
    (tmp_path / "d").write_bytes(pcap_bytes(30)[:-5])
    got = read(spark, str(tmp_path), 10**6)
    assert [r[0] for r in got] == [i + 1 for i in range(29) if i % 9]


def test_sync_passes_over_records_in_payloads():
    inner = b"".join(struct.pack("<IIII", 1000 + j, 5, 20, 20) + b"x" * 20 for j in range(40))
    records = b"".join(struct.pack("<IIII", 1_700_000_000 + i, 5, len(inner), len(inner)) + inner for i in range(600))
    kind, at = captures._sync(bytearray(records[100:]))
    assert kind == (False, "<") and at == 16 + len(inner) - 100
