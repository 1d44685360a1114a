"""WARC archives through a chunked record table.

Digest and length are carried over the chunks of a payload, of which a writing task holds one whole copy at a time. Chunks beyond the first are written as WARC continuation segments. Archives are written and read by
Spark's text source, so they can lie in any store that Spark reaches; the writer starts a new segment inside each record
separator that a payload holds, so a separator in an archive always ends a record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm import tokens as T
from flowspark.llm.salted import salted_join
from flowspark.llm.shared import written

CHUNK_BYTES = 64 << 10
VERSION = b"WARC/1.1\r\n"
GAP = b"\r\n\r\n"
SEPARATOR = GAP + VERSION
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_FLUSH = 4 << 20


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def cuts(payload: memoryview, size: int) -> Iterator[memoryview]:
    """Chunks of at most ``size`` bytes, none of which holds a record separator; one empty chunk for an empty payload."""
    at = 0
    while True:
        chunk = payload[at : at + size]
        found = chunk.obj.find(SEPARATOR, at, at + len(chunk)) if len(chunk) else -1
        if found >= 0:
            chunk = payload[at : found + len(GAP) + 1]
        yield chunk
        at += len(chunk)
        if at >= len(payload):
            return


def chunks(payload: bytes, size: int = CHUNK_BYTES) -> Iterator[tuple[int, memoryview, int, bytes, bool]]:
    """(chunk number, bytes, length so far, SHA-1 so far, last) of a payload."""
    state, length, total = hashlib.sha1(), 0, len(payload)
    for number, chunk in enumerate(cuts(memoryview(payload), size)):
        state.update(chunk)
        length += len(chunk)
        yield number, chunk, length, state.copy().digest(), length == total


def _payloads(df: DataFrame, id_col: str, payload_col: str, extra: dict[str, Column]) -> DataFrame:
    T.bound_batches(df.sparkSession)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    return df.select(F.col(id_col).alias("record"), payload.alias("payload"), *[c.alias(k) for k, c in extra.items()])


def digests(df: DataFrame, id_col: str, payload_col: str, size: int = CHUNK_BYTES) -> DataFrame:
    """(record, n_bytes, digest) per row, the digest carried over the record's chunks; null counts as empty."""
    rows = _payloads(df, id_col, payload_col, {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [[(n, d) for _, _, n, d, last in chunks(p.as_py(), size) if last][0] for p in batch.column("payload")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("record"), pa.array([n for n, _ in ends], pa.int64()), pa.array([d for _, d in ends], pa.binary())],
                names=["record", "n_bytes", "digest"],
            )

    return rows.mapInArrow(run, f"record {dict(rows.dtypes)['record']}, n_bytes long, digest binary")


def revisits(found: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(record, refers_to) of the records whose payload of ``min_bytes`` or more equals one with a smaller id."""
    groups = found.filter(F.col("n_bytes") >= min_bytes).groupBy("digest", "n_bytes").agg(
        F.min("record").alias("first"), F.max("record").alias("last")
    )
    shared = groups.filter("first < last").select("digest", "n_bytes", "first")
    rows = salted_join(found, shared, ["digest", "n_bytes"], F.col("record"), "inner")
    return rows.filter("record > first").select("record", F.col("first").alias("refers_to")).distinct()


def _uri(record, digest: bytes, segment: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{record}/{digest.hex()}/{segment}')}>"


def _head(fields: list[tuple[str, object]]) -> bytes:
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode() + b"\r\n"


def record_parts(record, uri: str | None, payload: bytes, refers_to, date: str, size: int, copy: str = "") -> Iterator[bytes]:
    """The WARC records of one page, each without the separator that ends it; ``copy`` tells repeated rows apart."""
    uri = None if uri is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in uri)
    length, digest, n = [(n, d, i + 1) for i, _, n, d, last in chunks(payload, size) if last][0]
    common = [("WARC-Target-URI", uri), ("WARC-Date", date), ("X-Record-Key", record), ("X-Copy", copy)]
    full = [("WARC-Payload-Digest", f"sha1:{base32(digest)}"), ("X-Payload-Length", length)]
    if refers_to is not None:
        yield _head([("WARC-Type", "revisit"), ("WARC-Record-ID", _uri(record, digest, 0)), *common, *full, ("WARC-Profile", PROFILE),
                     ("WARC-Refers-To", _uri(refers_to, digest, 0)), ("X-Refers-To-Key", refers_to), ("Content-Length", 0)])
        return
    origin = _uri(record, digest, 0)
    for number, chunk, _, _, last in chunks(payload, size):
        lead = b"" if number else _HTTP
        kind = [("WARC-Type", "continuation"), ("WARC-Segment-Origin-ID", origin)] if number else [("WARC-Type", "response")]
        segment = [("WARC-Segment-Number", number + 1)] if n > 1 else []
        if n > 1 and last:
            segment.append(("WARC-Segment-Total-Length", length + len(_HTTP)))
        block = hashlib.sha1(lead)
        block.update(chunk)
        yield b"".join((
            _head([*kind, ("WARC-Record-ID", _uri(record, digest, number)), *common, *(full if not number else []), *segment,
                   ("WARC-Block-Digest", f"sha1:{base32(block.digest())}"), ("Content-Type", "application/http;msgtype=response"),
                   ("Content-Length", len(lead) + len(chunk))]),
            lead, chunk,
        ))


def write_archive(
    df: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z", size: int = CHUNK_BYTES,
) -> None:
    """Write one record per row into WARC files below ``path``.

    Of rows with equal payloads of at least ``min_bytes`` the one with the smallest id is a response and the others
    revisit it; all other rows are responses. A null payload is empty. Rows that repeat the smallest id are all
    responses; a row with a null id is a response that nothing refers to. A null URI is left out.
    """
    again = written(revisits(digests(df, id_col, payload_col, size), min_bytes), "revisits")
    rows = _payloads(df, id_col, payload_col, {"uri": F.col(uri_col).cast("string")})
    # Spark broadcasts the revisits while they are small, else it shuffles both sides
    rows = rows.join(again, "record", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, task, row = [], 0, TaskContext.get().partitionId(), 0
        for batch in batches:
            for record, payload, uri, refers_to in zip(*(batch.column(c) for c in ("record", "payload", "uri", "refers_to"))):
                row += 1
                for part in record_parts(record.as_py(), uri.as_py(), payload.as_py(), refers_to.as_py(), date, size, f"{task}-{row}"):
                    out.append(part)
                    held += len(part)
                    if held >= _FLUSH:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    records = rows.select("record", "payload", "uri", "refers_to").mapInArrow(run, "value binary")
    records.select(F.col("value").cast("string")).write.option("lineSep", GAP.decode()).text(path)


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n") if ": " in line)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The archives as a chunk table: (origin, copy, record, kind, refers_to, chunk_no, last, n_bytes, digest, payload).

    The payload is null where the record has only this chunk; n_bytes and digest are then its own, as recomputed, and for
    revisits those of the record it refers to. A block shorter than its Content-Length raises an error.
    """
    T.bound_batches(spark)
    rows = spark.read.option("lineSep", SEPARATOR.decode()).text(path).select(F.col("value").cast("binary").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["origin", "copy", "record", "kind", "refers_to", "chunk_no", "last", "n_bytes", "digest", "payload"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            got = []
            for value in batch.column("value"):
                raw = value.as_py().removeprefix(VERSION)
                head, _, rest = raw.partition(GAP)
                h = _fields(head)
                size = int(h["Content-Length"])
                if len(rest) < size:
                    raise ValueError(f"record {h['WARC-Record-ID']} is cut off")
                kind, key, copy = h["WARC-Type"], h.get("X-Record-Key"), h.get("X-Copy")
                if kind == "revisit":
                    got.append((h["WARC-Record-ID"], copy, key, kind, h.get("X-Refers-To-Key"), 0, True, int(h["X-Payload-Length"]), h["WARC-Payload-Digest"][5:], None))
                    continue
                block = memoryview(rest)[:size]
                number = int(h.get("WARC-Segment-Number", 1)) - 1
                payload = block if number else block[rest.find(GAP) + len(GAP) :]
                if "WARC-Segment-Number" not in h:
                    got.append((h["WARC-Record-ID"], copy, key, kind, None, 0, True, len(payload), base32(hashlib.sha1(payload).digest()), None))
                else:
                    origin = h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"])
                    got.append((origin, copy, key, kind, None, number, "WARC-Segment-Total-Length" in h, len(payload), None, bytes(payload)))
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], k) for i, k in enumerate(kinds)], names=names)

    return rows.mapInArrow(run, "origin string, copy string, record string, kind string, refers_to string, chunk_no int, last boolean, n_bytes long, digest string, payload binary")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(record, payload_bytes, payload_digest, record_type, refers_to) of every record below ``path``.

    Chunks of a record meet in one task in their order and are digested one after the other; a record's chunks are never
    joined together. A missing chunk raises an error.
    """
    rows = read_chunks(spark, path).repartition("origin").sortWithinPartitions("origin", "copy", "chunk_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which = state = None
        length = following = 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["payload"] is None:
                    out.append((r["record"], r["n_bytes"], r["digest"], r["kind"], r["refers_to"]))
                    continue
                if r["chunk_no"] == 0:
                    which, state, length, following = (r["origin"], r["copy"]), hashlib.sha1(), 0, 0
                if (r["origin"], r["copy"]) != which or r["chunk_no"] != following:
                    raise ValueError(f"chunk {r['chunk_no']} of {r['origin']} comes out of turn")
                state.update(r["payload"])
                length, following = length + r["n_bytes"], following + 1
                if r["last"]:
                    out.append((r["record"], length, base32(state.digest()), "response", None))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            names = ["record", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)

    return rows.mapInArrow(run, "record string, payload_bytes long, payload_digest string, record_type string, refers_to string")
