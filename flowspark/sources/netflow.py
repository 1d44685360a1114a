"""NetFlow v5, v9, IPFIX and sFlow v5 datagrams to flow exports.

Variable-length parts are walked in Arrow batches, all datagrams of a batch at once, so decoding costs a few array
operations per section and runs unchanged on streams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.functions.keys import be_ipv4, be_uint, long_to_ipv4
from flowspark.operators.ordered import Ordered
from flowspark.sources.binary import int32, packed, sections, slices, uint, uint_or

MICRO = 1_000_000
EXPORT = (
    "flow_start", "flow_end", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packets", "bytes",
    "input_snmp", "output_snmp", "src_as", "dst_as", "tcp_flags", "exporter_ip", "engine_type", "engine_id",
    "vendor_props",
)


def _no_props() -> Column:
    return F.create_map().cast("map<string,string>")


def _others(df: DataFrame, *used: str) -> list[str]:
    return [c for c in df.columns if c not in used and c not in EXPORT]


# --- v5 ----------------------------------------------------------------------------
def decode_netflow_v5(df: DataFrame, datagram: str = "datagram", exporter: str = "exporter") -> DataFrame:
    """One row per complete 48-byte record of v5 datagrams."""
    data = F.col(datagram)
    size = F.octet_length(data)
    whole = F.floor((size - 24) / 48).cast("int")
    count = F.least(be_uint(data, 3, 2).cast("int"), whole)
    heads = df.filter((size >= 24) & (be_uint(data, 1, 2) == 5)).withColumns(
        {
            "_n": count,
            "_uptime": be_uint(data, 5, 4),
            "_secs": be_uint(data, 9, 4) + be_uint(data, 13, 4) / F.lit(1e9),
            "_etype": be_uint(data, 21, 1).cast("int"),
            "_eid": be_uint(data, 22, 1).cast("int"),
        }
    )
    rows = heads.filter(F.col("_n") > 0).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    rows = rows.withColumn("_r", F.substring(data, F.lit(25) + F.col("_i") * 48, F.lit(48)))
    r = F.col("_r")

    def at(offset: int, width: int, kind: str = "int") -> Column:
        return be_uint(r, offset + 1, width).cast(kind)

    def clock(ms: Column) -> Column:
        return F.col("_secs") - (F.col("_uptime") - ms) / F.lit(1000.0)

    return rows.select(
        *_others(df, datagram, exporter),
        clock(at(24, 4, "long")).alias("flow_start"),
        clock(at(28, 4, "long")).alias("flow_end"),
        be_ipv4(r, 1).alias("src_ip"),
        be_ipv4(r, 5).alias("dst_ip"),
        at(32, 2).alias("src_port"),
        at(34, 2).alias("dst_port"),
        at(38, 1).alias("protocol"),
        at(16, 4, "long").alias("packets"),
        at(20, 4, "long").alias("bytes"),
        at(12, 2, "long").alias("input_snmp"),
        at(14, 2, "long").alias("output_snmp"),
        at(40, 2, "long").alias("src_as"),
        at(42, 2, "long").alias("dst_as"),
        at(37, 1).alias("tcp_flags"),
        F.col(exporter).alias("exporter_ip"),
        F.col("_etype").alias("engine_type"),
        F.col("_eid").alias("engine_id"),
        _no_props().alias("vendor_props"),
    )


# --- sets and templates ----------------------------------------------------------------
def _export_sets(data: pa.Array, version: int) -> tuple[np.ndarray, ...]:
    """(bytes, datagram start, row, id, from, to) of the flow sets of v9 or the sets of IPFIX messages in a batch."""
    buf, start, end = packed(data)
    head = 20 if version == 9 else 16
    mine = (end - start >= 16) & (uint_or(buf, start, end, 2) == version)
    row, number, a, b = sections(buf, np.where(mine, start + head, end), end, 4)
    return buf, start, row, number, a, b


def _templates_of(body: bytes, ipfix: bool) -> list[tuple[int, list[tuple[int, int]]]]:
    """(id, [(field, length)]) of a template set, read word by word (every entry is 4-byte aligned).

    Enterprise numbers are skipped and the enterprise bit is masked. A cut last template counts as it stands.
    """
    found: list[tuple[int, list[tuple[int, int]]]] = []
    left, skip = 0, False
    for at in range(0, len(body) - 3, 4):
        hi, lo = int.from_bytes(body[at : at + 2], "big"), int.from_bytes(body[at + 2 : at + 4], "big")
        if skip:
            skip = False
        elif left > 0:
            found[-1][1].append((hi & 0x7FFF if ipfix else hi, lo))
            left, skip = left - 1, ipfix and hi >= 0x8000
        elif hi >= 256:
            found.append((hi, []))
            left = lo
    return found


def _template_rows(df: DataFrame, datagram: str, exporter: str, version: int) -> DataFrame:
    set_id = 0 if version == 9 else 2
    kinds = pa.struct([("ftype", pa.int32()), ("flen", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, start, row, number, a, b = _export_sets(batch.column(1), version)
            mine = number == set_id
            row, a, b = row[mine], a[mine], b[mine]
            sent = uint(buf, start[row] + (8 if version == 9 else 4), 4) * MICRO
            # most datagrams repeat the templates of others
            bodies = slices(buf, a, b).dictionary_encode()
            read = [_templates_of(body, version == 10) for body in bodies.dictionary.to_pylist()]
            each = np.array([len(t) for t in read], np.int64)
            first = np.concatenate(([0], np.cumsum(each)))
            which = bodies.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            n = each[which] if len(which) else np.zeros(0, np.int64)
            of = np.repeat(np.arange(len(which)), n)
            at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[which[of]]
            every = [t for ts in read for t in ts]
            ids = np.array([t for t, _ in every], np.int32)
            specs = pa.array([[{"ftype": f, "flen": size} for f, size in spec] for _, spec in every], pa.list_(kinds))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row[of])), pa.array(ids[at], pa.int32()), specs.take(pa.array(at)), pa.array(sent[of])],
                names=["exporter", "template_id", "spec", "seen_us"],
            )

    rows = df.filter(F.col(datagram).isNotNull()).select(F.col(exporter).cast("string").alias("exporter"), F.col(datagram).cast("binary").alias("datagram"))
    return rows.mapInArrow(run, "exporter string, template_id int, spec array<struct<ftype:int,flen:int>>, seen_us long")


def netflow_v9_templates(df: DataFrame, datagram: str = "datagram", exporter: str = "exporter") -> DataFrame:
    """``exporter, template_id, spec, seen_us`` of every v9 template."""
    return _template_rows(df, datagram, exporter, 9)


def netflow_ipfix_templates(df: DataFrame, datagram: str = "datagram", exporter: str = "exporter") -> DataFrame:
    """The same for IPFIX: enterprise numbers are skipped and the enterprise bit is masked."""
    return _template_rows(df, datagram, exporter, 10)


# --- as-of templates ------------------------------------------------------------------
def template_spans(templates: DataFrame, timeout_s: int = 3600) -> DataFrame:
    """Validity spans of templates: repeated identical ones merge into one row.

    Exporters resend templates all the time but seldom change them, so the result is small
    whatever the traffic.
    """
    one = templates.groupBy("exporter", "template_id", "seen_us").agg(F.max("spec").alias("spec"))
    key = ["exporter", "template_id"]
    steps = Ordered(one, key, ["seen_us"]).prev(_us="seen_us", _spec="spec").result()
    changed = (
        F.col("_us").isNull()
        | (F.col("seen_us") - F.col("_us") > timeout_s * MICRO)
        | ~F.col("spec").eqNullSafe(F.col("_spec"))
    )
    # one row per change of a template; what was seen last of a run stands beside the next run's start
    starts = steps.filter(changed).select(*key, F.col("seen_us").alias("from_us"), "spec", "_us")
    following = Window.partitionBy(*key).orderBy("from_us")
    ended = F.lead(F.struct("from_us", "_us")).over(following)
    spans = starts.withColumn("_next", ended).drop("_us")
    # the same columns as above, so that the templates are read and shuffled once
    latest = one.groupBy(*key).agg(F.max(F.struct("seen_us", "spec")).alias("_latest"))
    spans = spans.join(latest, key)
    last = F.coalesce(F.col("_next._us"), F.col("_latest.seen_us"))
    upto = F.least(last + timeout_s * MICRO, F.col("_next.from_us") - 1)
    return spans.select(*key, "from_us", upto.alias("upto_us"), "spec")


def asof_templates(data: DataFrame, templates: DataFrame, timeout_s: int = 3600, ts: str = "ts_us") -> DataFrame:
    """Each row with the newest template at or before its time, at most ``timeout_s`` old (inner).

    Rows meet only the spans that touch their stretch of ``timeout_s``, not all of their template's.
    """
    width = max(timeout_s, 1) * MICRO
    spans = template_spans(templates, timeout_s)
    first, last = F.floor(F.col("from_us") / width), F.floor(F.col("upto_us") / width)
    spans = spans.filter("upto_us >= from_us").withColumn("_bucket", F.explode(F.sequence(first, last)))
    held = F.col(ts).between(F.col("from_us"), F.col("upto_us"))
    rows = data.withColumn("_bucket", F.floor(F.col(ts) / width))
    return rows.join(spans, ["exporter", "template_id", "_bucket"]).filter(held).drop("from_us", "upto_us", "_bucket")


# --- v9 and IPFIX data -----------------------------------------------------------------
# fixed values: field numbers
FIELDS = {
    "src_ip": 8, "dst_ip": 12, "src_port": 7, "dst_port": 11, "protocol": 4, "bytes": 1, "packets": 2,
    "first": 22, "last": 21, "input_snmp": 10, "output_snmp": 14, "src_as": 16, "dst_as": 17, "tcp_flags": 6,
}


CLOCKS = ("first", "last")


def _data_sets(df: DataFrame, others: list[str], datagram: str, exporter: str, version: int) -> DataFrame:
    """Data sets with their message's times and source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, start, row, number, a, b = _export_sets(batch.column(batch.num_columns - 1), version)
            mine = number >= 256
            row, number, a, b = row[mine], number[mine], a[mine], b[mine]
            at = start[row]
            secs = uint(buf, at + (8 if version == 9 else 4), 4)
            uptime = pa.array(uint(buf, at + 4, 4)) if version == 9 else pa.nulls(len(row), pa.int64())
            taken = [c.take(pa.array(row)) for c in batch.columns[:-1]]
            own = [uptime, pa.array(secs), pa.array(uint(buf, at + (16 if version == 9 else 12), 4)), pa.array(secs * MICRO)]
            yield pa.RecordBatch.from_arrays(
                [*taken, *own, pa.array(number, pa.int32()), slices(buf, a, b)],
                names=[*batch.schema.names[:-1], "_uptime", "_secs", "_source", "ts_us", "template_id", "_body"],
            )

    rows = df.filter(F.col(datagram).isNotNull()).select(*others, F.col(exporter).cast("string").alias("exporter"), F.col(datagram).cast("binary").alias("_datagram"))
    kept = T.StructType([*rows.schema.fields[:-1], *T.StructType.fromDDL("_uptime long, _secs long, _source long, ts_us long, template_id int, _body binary").fields])
    return rows.mapInArrow(run, kept)


def _records(bodies: pa.Array, spec_keys: np.ndarray, specs: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """(row, field values, which clocks are given) of every record in the bodies, row by row.

    A repeated field number keeps its last place; fields of other than 1, 2 or 4 bytes, and missing ones, count as 0.
    """
    buf, start, end = packed(bodies)
    _, firsts, group = np.unique(spec_keys, return_index=True, return_inverse=True)
    rows, values, given = [], {name: [] for name in FIELDS}, []
    for g, first in enumerate(firsts):
        places, size = {}, 0
        for field in specs[int(first)].as_py():
            places[field["ftype"]] = (size, field["flen"])
            size += field["flen"]
        mine = np.flatnonzero(group == g)
        if size <= 0:
            continue
        n = (end[mine] - start[mine]) // size
        of = np.repeat(mine, n)
        at = start[of] + (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * size
        rows.append(of)
        for name, number in FIELDS.items():
            pos, flen = places.get(number, (0, 0))
            known = flen in ((4,) if name in ("src_ip", "dst_ip") else (1, 2, 4))
            values[name].append(uint(buf, at + pos, flen) if known else np.zeros(len(of), np.int64))
        given.append(np.tile([[FIELDS[c] in places for c in CLOCKS]], (len(of), 1)))
    if not rows:
        return np.zeros(0, np.int64), {name: np.zeros(0, np.int64) for name in FIELDS}, np.zeros((0, 2), bool)
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return row[order], {name: np.concatenate(v)[order] for name, v in values.items()}, np.concatenate(given)[order]


def _data_rows(df: DataFrame, templates: DataFrame, datagram: str, exporter: str, timeout_s: int, version: int) -> DataFrame:
    others = [c for c in _others(df, datagram, exporter) if c != "ts_us"]
    sets = _data_sets(df, others, datagram, exporter, version)
    rows = asof_templates(sets, templates, timeout_s)
    rows = rows.select(*others, "exporter", "_uptime", "_secs", "_source", "_body", F.xxhash64("spec").alias("_key"), "spec")
    numbers = list(FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, key, spec = (batch.column(batch.num_columns - i) for i in (3, 2, 1))
            row, values, given = _records(body, key.to_numpy(zero_copy_only=False), spec)
            uptime, secs = batch.column(len(others) + 1), batch.column(len(others) + 2).to_numpy(zero_copy_only=False)[row]
            times = []
            for i, name in enumerate(CLOCKS):
                # without a device uptime both times are the export time
                back = 0.0 if uptime.null_count else np.where(given[:, i], (uptime.to_numpy()[row] - values[name]) / 1000.0, 0.0)
                times.append(pa.array(secs - back if len(row) else np.zeros(0), pa.float64()))
            taken = [batch.column(i).take(pa.array(row)) for i in (*range(len(others) + 1), len(others) + 3)]
            yield pa.RecordBatch.from_arrays(
                [*taken, *times, *[pa.array(values[n]) for n in numbers]], names=[*others, "exporter", "_source", "flow_start", "flow_end", *[f"_{n}" for n in numbers]]
            )

    names = ", ".join(["_source long", "flow_start double", "flow_end double", *[f"_{n} long" for n in numbers]])
    out = T.StructType([*[rows.schema[c] for c in (*others, "exporter")], *T.StructType.fromDDL(names).fields])
    found = rows.mapInArrow(run, out)
    value = lambda name: F.col(f"_{name}")
    return found.select(
        *others,
        "flow_start",
        "flow_end",
        long_to_ipv4(value("src_ip")).alias("src_ip"),
        long_to_ipv4(value("dst_ip")).alias("dst_ip"),
        *[value(n).cast("int").alias(n) for n in ("src_port", "dst_port", "protocol")],
        *[value(n).alias(n) for n in ("packets", "bytes", "input_snmp", "output_snmp", "src_as", "dst_as")],
        value("tcp_flags").cast("int").alias("tcp_flags"),
        F.col("exporter").alias("exporter_ip"),
        F.shiftright("_source", 16).cast("int").alias("engine_type"),
        F.col("_source").bitwiseAND(F.lit(0xFFFF)).cast("int").alias("engine_id"),
        _no_props().alias("vendor_props"),
    )


def decode_netflow_v9(df: DataFrame, templates: DataFrame | None = None, timeout_s: int = 3600, datagram: str = "datagram", exporter: str = "exporter") -> DataFrame:
    """Data records of v9 datagrams by the template valid when they were sent."""
    known = netflow_v9_templates(df, datagram, exporter) if templates is None else templates
    return _data_rows(df, known, datagram, exporter, timeout_s, 9)


def decode_ipfix(df: DataFrame, templates: DataFrame | None = None, timeout_s: int = 3600, datagram: str = "datagram", exporter: str = "exporter") -> DataFrame:
    """The same for IPFIX messages; without a device uptime both times are the export time."""
    known = netflow_ipfix_templates(df, datagram, exporter) if templates is None else templates
    return _data_rows(df, known, datagram, exporter, timeout_s, 10)


# --- sFlow v5 ----------------------------------------------------------------------------
RAW_HEADER = (0x00000001, 0x00010001)  # fixed values: record formats of a sampled raw header


def _sampled(data: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(row, numbers) of every sampled IPv4 TCP/UDP header in a batch of sFlow v5 datagrams."""
    buf, start, end = packed(data)
    mine = (end - start >= 28) & (uint_or(buf, start, end, 4) == 5)
    shift = np.where(uint_or(buf, start + 4, end, 4) == 2, 12, 0)
    claimed = uint_or(buf, start + 24 + shift, end, 4, 0)
    rest = start + 28 + shift
    steps = np.minimum(int32(claimed), (end - rest) // 8)
    row, number, a, b = sections(buf, np.where(mine & (claimed > 0), rest, end), end, 8, steps)
    kept = (number == 1) & (b - a >= 32)
    row, a, b = row[kept], a[kept], b[kept]
    steps = np.minimum(int32(uint(buf, a + 28, 4)), (b - a) // 8)
    came, went = uint(buf, a + 20, 4), uint(buf, a + 24, 4)
    of, number, a, b = sections(buf, a + 32, b, 8, steps)
    kept = np.isin(number, RAW_HEADER) & (b - a >= 16)
    of, a, b = of[kept], a[kept], b[kept]
    size, frame = uint(buf, a + 4, 4), a + 16
    end = np.minimum(b, frame + np.maximum(int32(uint(buf, a + 12, 4)), 0))
    # Ethernet II, IPv4, TCP or UDP, with the ports inside
    kept = end - frame >= 34
    of, size, frame, end = of[kept], size[kept], frame[kept], end[kept]
    first, protocol = uint(buf, frame + 14, 1), uint(buf, frame + 23, 1)
    ports = frame + 14 + (first & 15) * 4
    kept = (uint(buf, frame + 12, 2) == 0x0800) & (first >> 4 == 4) & np.isin(protocol, (6, 17)) & (ports + 4 <= end)
    of, size, frame, ports, protocol = of[kept], size[kept], frame[kept], ports[kept], protocol[kept]
    return row[of], {
        "_src": uint(buf, frame + 26, 4), "_dst": uint(buf, frame + 30, 4), "_sport": uint(buf, ports, 2),
        "_dport": uint(buf, ports + 2, 2), "_proto": protocol, "_bytes": size, "_in": came[of], "_out": went[of],
    }


def decode_sflow(df: DataFrame, datagram: str = "datagram", exporter: str = "exporter", received_us: str | None = None) -> DataFrame:
    """One row per sampled IPv4 TCP/UDP header of sFlow v5 flow samples."""
    data = F.col(datagram)
    others = _others(df, datagram, exporter, received_us or "")
    agent = F.when(be_uint(data, 5, 4) == 2, F.lower(F.hex(F.substring(data, 9, 16)))).otherwise(be_ipv4(data, 9))
    now = F.col(received_us) if received_us else F.unix_micros(F.current_timestamp())
    heads = df.filter(data.isNotNull()).select(
        *others, F.col(exporter).alias("_exporter"), agent.alias("_agent"), (now / F.lit(1e6)).alias("_when"), data.cast("binary").alias("_datagram")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, values = _sampled(batch.column(batch.num_columns - 1))
            taken = [c.take(pa.array(row)) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*taken, *[pa.array(v) for v in values.values()]], names=[*batch.schema.names[:-1], *values])

    numbers = T.StructType.fromDDL("_src long, _dst long, _sport long, _dport long, _proto long, _bytes long, _in long, _out long")
    rows = heads.mapInArrow(run, T.StructType([*heads.schema.fields[:-1], *numbers.fields]))
    zero = F.lit(0).cast("long")
    return rows.select(
        *others,
        F.col("_when").alias("flow_start"),
        F.col("_when").alias("flow_end"),
        long_to_ipv4(F.col("_src")).alias("src_ip"),
        long_to_ipv4(F.col("_dst")).alias("dst_ip"),
        F.col("_sport").cast("int").alias("src_port"),
        F.col("_dport").cast("int").alias("dst_port"),
        F.col("_proto").cast("int").alias("protocol"),
        F.lit(1).cast("long").alias("packets"),
        F.col("_bytes").alias("bytes"),
        F.col("_in").alias("input_snmp"),
        F.col("_out").alias("output_snmp"),
        zero.alias("src_as"),
        zero.alias("dst_as"),
        F.lit(0).alias("tcp_flags"),
        F.col("_exporter").alias("exporter_ip"),
        F.lit(0).alias("engine_type"),
        F.lit(0).alias("engine_id"),
        F.create_map(F.lit("sflow_agent"), F.col("_agent")).alias("vendor_props"),
    )
