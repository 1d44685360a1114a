"""Registered source queries: raw text and binary are built from ``lineitem`` and decoded again.

The SQL side states the expected records straight from the columns, so it does not repeat
the decoder.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowspark.functions.keys import directed_key, strip_mapped_ipv4
from flowspark.functions.times import epoch_from_rfc3339, zeek_ts
from flowspark.plans import views as V
from flowspark.plans.catalog import dealt, query, table
from flowspark.sources import cloud, frames, netflow, tables, zeek

_LINE_SQL = f"""
li AS (
  SELECT *, l_orderkey * 8 + l_linenumber AS id, epoch_us(l_shipdate) // 1000000 AS secs,
    {V._sql_ip('10.', 'l_suppkey')} AS src, {V._sql_ip('172.', 'l_partkey')} AS dst,
    CAST(1024 + l_partkey % 60000 AS INTEGER) AS sport, CAST(1 + l_suppkey % 1000 AS INTEGER) AS dport,
    CASE WHEN l_linenumber % 2 = 0 THEN 6 ELSE 17 END AS proto, CAST(l_quantity AS BIGINT) AS pk,
    CAST(floor(l_extendedprice) AS BIGINT) AS nb, (l_orderkey * 8 + l_linenumber) % 17 = 0 AS damaged
  FROM lineitem
)"""


def _lines(spark, d):
    supp, part, no = F.col("l_suppkey"), F.col("l_partkey"), F.col("l_linenumber")
    key = F.col("l_orderkey") * 8 + no
    return dealt(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber").select(
        "*",
        key.alias("id"),
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("secs"),
        V._ip("10.", supp).alias("src"),
        V._ip("172.", part).alias("dst"),
        (F.lit(1024) + part % 60000).cast("int").alias("sport"),
        (F.lit(1) + supp % 1000).cast("int").alias("dport"),
        F.when(no % 2 == 0, 6).otherwise(17).alias("proto"),
        F.col("l_quantity").cast("long").alias("pk"),
        F.floor("l_extendedprice").alias("by"),
        (key % 17 == 0).alias("damaged"),
    )


# --- cloud logs ---------------------------------------------------------------------------
def aws_lines(spark, d):
    df = _lines(spark, d)
    version = 2 + F.col("l_linenumber") % 3
    base = F.concat_ws(
        " ", version, F.lit("acct"), F.concat(F.lit("eni-"), F.col("l_suppkey")), "src", "dst",
        F.when(F.col("damaged") & (F.col("id") % 2 == 0), "x").otherwise(F.col("sport").cast("string")),
        "dport", "proto", "pk", "by", "secs", F.col("secs") + F.col("l_linenumber") - 3,
        F.when(F.col("l_returnflag") == "R", "REJECT").otherwise("ACCEPT"), F.lit("OK"),
    )
    v3 = F.concat_ws(
        " ", "dst", "src", F.when(F.col("id") % 5 == 0, "-").otherwise(F.col("dport").cast("string")), "sport",
        F.col("l_linenumber"), F.lit("IPv4"), F.lit("region"), F.lit("az"), F.lit("subnet"),
        F.concat(F.lit("vpc-"), F.col("l_partkey") % 7),
    )
    v4 = F.concat_ws(" ", F.concat(F.lit("i-"), "l_orderkey"), F.lit("vs"), F.lit("vd"), F.lit("ingress"))
    full = F.when(version == 2, base).when(version == 3, F.concat_ws("  ", base, v3)).otherwise(F.concat_ws("\t", base, v3, v4))
    short = F.substring_index(base, " ", 9)
    text = F.when(F.col("damaged") & (F.col("id") % 2 == 1), short).otherwise(full)
    return df.select("id", F.concat(F.lit(" "), text).alias("line"))


_AWS_SQL = """
aws AS (
  SELECT id, CAST(2 + l_linenumber % 3 AS INTEGER) AS version, 'acct' AS account_id, 'eni-' || l_suppkey AS interface_id,
    src AS src_ip, dst AS dst_ip, sport AS src_port, dport AS dst_port, proto AS protocol, pk AS packets, nb AS bytes,
    secs AS start_time, secs + l_linenumber - 3 AS end_time, CASE WHEN l_returnflag = 'R' THEN 'REJECT' ELSE 'ACCEPT' END AS action,
    CASE WHEN l_linenumber % 3 >= 1 AND id % 5 <> 0 THEN dport END AS pkt_src_port, CASE WHEN l_linenumber % 3 >= 1 THEN 'vpc-' || (l_partkey % 7) END AS vpc_id,
    CASE WHEN l_linenumber % 3 = 2 THEN 'i-' || l_orderkey END AS instance_id, CASE WHEN l_linenumber % 3 = 2 THEN 'ingress' END AS direction
  FROM li WHERE NOT damaged
)"""


@query(
    "parse_aws_flow",
    f"""WITH {_LINE_SQL}, {_AWS_SQL} SELECT *, greatest(0, end_time - start_time) AS duration_s, action = 'REJECT' AS is_rejected FROM aws""",
)
def parse_aws_flow(spark, d):
    return cloud.aws_derived(cloud.parse_aws_flow(aws_lines(spark, d))).select(
        "id", "version", "account_id", "interface_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packets",
        "bytes", "start_time", "end_time", "action", "pkt_src_port", "vpc_id", "instance_id", "direction", "duration_s",
        "is_rejected",
    )


@query(
    "dead_letters",
    f"""WITH {_LINE_SQL} SELECT CASE WHEN id % 2 = 0 THEN 'not a number' ELSE 'too few fields' END AS error, count(*) AS n
FROM li WHERE damaged GROUP BY 1""",
)
def dead_letters(spark, d):
    _, bad = tables.split_bad(cloud.parse_aws_flow(aws_lines(spark, d), keep_bad=True))
    return bad.groupBy(F.col("_error").alias("error")).agg(F.count(F.lit(1)).alias("n"))


def gcp_lines(spark, d):
    df = _lines(spark, d)
    port = F.when(F.col("damaged"), F.when(F.col("id") % 2 == 0, "null").otherwise('"x"')).otherwise(F.col("sport").cast("string"))
    iso = F.date_format(F.timestamp_seconds("secs"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = F.concat(
        F.lit('{"start_time": "'), iso, F.lit('", "src_ip": "'), "src", F.lit('", "dst_ip": "'), "dst",
        F.lit('", "src_port": '), port, F.lit(', "dst_port": "'), "dport", F.lit('", "protocol": '), "proto",
        F.when(F.col("id") % 3 > 0, F.concat(F.lit(', "packets": '), "pk")).otherwise(""),
        F.lit(', "bytes": '), "by", F.lit(', "reporter": "'),
        F.when(F.col("id") % 3 == 0, "SRC").when(F.col("id") % 3 == 1, "DEST").otherwise("BOTH"),
        F.lit('", "tcp_flags_syn": '), F.when(F.col("id") % 2 == 0, "true").otherwise("false"), F.lit("}"),
    )
    wrapped = F.concat(F.lit('{"insertId": "a", "jsonPayload": '), body, F.lit("}"))
    return df.select("id", F.when(F.col("l_linenumber") % 2 == 0, wrapped).otherwise(body).alias("line"))


_GCP_SQL = """
gcp AS (
  SELECT id, src AS src_ip, dst AS dst_ip, sport AS src_port, dport AS dst_port, proto AS protocol,
    CASE WHEN id % 3 > 0 THEN pk ELSE 0 END AS packets, nb AS bytes, CASE id % 3 WHEN 0 THEN 'SRC' WHEN 1 THEN 'DEST' ELSE 'BOTH' END AS reporter,
    id % 2 = 0 AS tcp_flags_syn, false AS tcp_flags_ack, CAST(secs AS DOUBLE) AS epoch
  FROM li WHERE NOT damaged
)"""


@query("parse_gcp_flow", f"WITH {_LINE_SQL}, {_GCP_SQL} SELECT * FROM gcp")
def parse_gcp_flow(spark, d):
    df = cloud.parse_gcp_flow(gcp_lines(spark, d)).withColumn("epoch", epoch_from_rfc3339("start_time"))
    return df.select(
        "id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packets", "bytes", "reporter", "tcp_flags_syn",
        "tcp_flags_ack", "epoch",
    )


def azure_docs(spark, d):
    """One document per line item with two tuples, one of them sometimes malformed."""
    first = F.concat_ws(",", "secs", "src", "dst", "sport", "dport", "proto", F.lit("A"), F.lit("I"))
    second = F.concat_ws(
        ",", "secs", "dst", "src", F.when(F.col("damaged"), "x").otherwise(F.col("dport").cast("string")), "sport",
        "proto", F.lit("D"), F.lit("O"),
    )
    doc = F.concat(
        F.lit('{"records": [{"time": "t", "resourceId": "res'), F.col("l_suppkey") % 3,
        F.lit('", "properties": {"flows": [{"rule": "rule'), F.col("l_linenumber"),
        F.lit('", "flows": [{"mac": "m", "flowTuples": ["'), first, F.lit('", "'), second, F.lit('"]}]}]}}]}'),
    )
    return _lines(spark, d).select("id", doc.alias("doc"))


_AZURE_SQL = """
azure AS (
  SELECT id, 'rule' || l_linenumber AS rule, 'res' || (l_suppkey % 3) AS resource_id, secs AS "timestamp", src AS src_ip, dst AS dst_ip,
    sport AS src_port, dport AS dst_port, proto AS protocol, 'A' AS action, 'I' AS direction FROM li
  UNION ALL SELECT id, 'rule' || l_linenumber, 'res' || (l_suppkey % 3), secs, dst, src, dport, sport, proto, 'D', 'O' FROM li WHERE NOT damaged
)"""


@query("parse_azure_flow", f"WITH {_LINE_SQL}, {_AZURE_SQL} SELECT * FROM azure")
def parse_azure_flow(spark, d):
    return cloud.parse_azure_flow(azure_docs(spark, d)).drop("system_id")


@query(
    "union_cloud",
    f"""WITH {_LINE_SQL}, {_AWS_SQL}, {_GCP_SQL}, {_AZURE_SQL},
u AS (
  SELECT 'aws' AS provider, CAST(start_time AS DOUBLE) AS "timestamp", src_ip, dst_ip, src_port, dst_port, protocol, packets, bytes, action, direction,
    'OK|' || coalesce(vpc_id, '') AS meta FROM aws
  UNION ALL SELECT 'gcp', epoch, src_ip, dst_ip, src_port, dst_port, protocol, packets, bytes,
    CASE reporter WHEN 'SRC' THEN 'EGRESS' WHEN 'DEST' THEN 'INGRESS' ELSE 'ALLOW' END, NULL, '|' || reporter FROM gcp
  UNION ALL SELECT 'azure', CAST("timestamp" AS DOUBLE), src_ip, dst_ip, src_port, dst_port, protocol, 1, 0, action, direction, rule || '|' || resource_id FROM azure
)
SELECT *, src_ip || ':' || src_port || '->' || dst_ip || ':' || dst_port || '/' || protocol AS flow_key FROM u""",
)
def union_cloud(spark, d):
    out = cloud.union_cloud(
        cloud.parse_aws_flow(aws_lines(spark, d)),
        cloud.parse_gcp_flow(gcp_lines(spark, d)),
        cloud.parse_azure_flow(azure_docs(spark, d)),
    )
    m = F.col("metadata")
    meta = (
        F.when(F.col("provider") == "aws", F.concat(m["log_status"], F.lit("|"), m["vpc_id"]))
        .when(F.col("provider") == "gcp", F.concat(m["src_vpc_network"], F.lit("|"), m["reporter"]))
        .otherwise(F.concat(m["rule"], F.lit("|"), m["resource_id"]))
    )
    return out.withColumn("meta", meta).drop("metadata")


# --- Zeek ------------------------------------------------------------------------------------
_ZEEK_HEADER = "#fields\tts\tuid\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\tduration\torig_bytes\tlocal_orig\ttags\thistory"


def zeek_lines(spark, d):
    no = F.col("l_linenumber")
    values = F.concat_ws(
        "\t", F.concat("secs", F.lit(".25")), F.concat(F.lit("C"), F.col("id")), "src", "sport", "dst", "dport",
        F.when(F.col("proto") == 6, "tcp").otherwise("udp"), F.format_string("%.2f", F.col("l_discount")),
        F.when(no == 1, "-").otherwise(F.col("by").cast("string")), F.when(no % 2 == 0, "T").otherwise("F"),
        F.concat(F.lit("a"), no, F.lit(", b")), F.lit("ShADad"),
    )
    line = F.when(F.col("damaged"), F.substring_index(values, "\t", 9)).when(F.col("id") % 13 == 0, F.concat(values, F.lit("\textra"))).otherwise(values)
    return _lines(spark, d).select(
        "id", line.alias("line"), zeek.header_fields(F.lit(_ZEEK_HEADER)).alias("header"),
        F.concat(F.lit("/logs/"), F.when(no == 3, "conn").when(no == 5, "DNS").otherwise("trace"), F.lit(".log.gz")).alias("file_path"),
    )


@query(
    "zeek_records",
    f"""WITH {_LINE_SQL}
SELECT id, CASE l_linenumber WHEN 5 THEN 'dns' ELSE 'conn' END AS log_type, secs + 0.25e0 AS "timestamp", 'C' || id AS uid,
  src || ':' || sport || '->' || dst || ':' || dport || '/' || CASE proto WHEN 6 THEN 'tcp' ELSE 'udp' END AS flow_key,
  CAST(sport AS BIGINT) AS orig_p, l_discount AS duration, CASE WHEN l_linenumber <> 1 THEN nb END AS orig_bytes,
  CASE WHEN NOT damaged THEN l_linenumber % 2 = 0 END AS local_orig, CASE WHEN NOT damaged THEN 'a' || l_linenumber || '|b' END AS tags,
  CASE WHEN NOT damaged THEN 'ShADad' END AS history
FROM li""",
)
def zeek_records(spark, d):
    df = zeek.normalize_zeek(zeek.parse_zeek_lines(zeek_lines(spark, d)))
    f = zeek.zeek_field
    return df.select(
        "id", "log_type", "timestamp", zeek.zeek_uid().alias("uid"), zeek.zeek_flow_key().alias("flow_key"),
        f("id.orig_p")["i"].alias("orig_p"), f("duration")["d"].alias("duration"), f("orig_bytes")["i"].alias("orig_bytes"),
        f("local_orig")["b"].alias("local_orig"), F.array_join(f("tags")["arr"], "|").alias("tags"), f("history")["s"].alias("history"),
    )


@query(
    "time_texts",
    """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 0 ELSE epoch_us(ts) / CAST(1e6 AS DOUBLE) END AS rfc,
  CASE WHEN event_id % 11 = 0 THEN 0 ELSE CAST(event_id AS DOUBLE) + 0.5e0 END AS zeek FROM events""",
)
def time_texts(spark, d):
    eid = F.col("event_id")
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    bad = eid % 11 == 0
    return table(spark, d, "events").select(
        "event_id",
        epoch_from_rfc3339(F.when(bad, "soon").otherwise(text)).alias("rfc"),
        zeek_ts(F.when(bad, "-").otherwise(F.concat(eid, F.lit(".5")))).alias("zeek"),
    )


# --- binary -----------------------------------------------------------------------------------
def _hx(c: Column, width: int) -> Column:
    """Number as ``width`` big-endian bytes in hex."""
    return F.lpad(F.hex(c.cast("long")), width * 2, "0")


def _ip_hex(first: int, n: Column) -> Column:
    return F.concat(F.lit(f"{first:02X}"), _hx(F.floor(n / 65536) % 256, 1), _hx(F.floor(n / 256) % 256, 1), _hx(n % 256, 1))


def _frame_hex() -> Column:
    kind = F.when(F.col("damaged"), "86DD").otherwise("0800")
    # five-word headers, six-word ones on every third record
    long_head = F.col("id") % 3 == 0
    return F.concat(
        F.lit("AA" * 12), kind, F.when(long_head, "46").otherwise("45"), F.lit("00" * 8), _hx(F.col("proto"), 1), F.lit("0000"),
        _ip_hex(10, F.col("l_suppkey")), _ip_hex(172, F.col("l_partkey")), F.when(long_head, "01010101").otherwise(""),
        _hx(F.col("sport"), 2), _hx(F.col("dport"), 2), F.when(F.col("id") % 19 == 0, "").otherwise("00" * 8),
    )


@query(
    "decode_frames",
    f"""WITH {_LINE_SQL}
SELECT id, src AS src_ip, dst AS dst_ip, sport AS src_port, dport AS dst_port, proto AS protocol,
  src || ':' || sport || '->' || dst || ':' || dport || '/' || proto AS flow_key FROM li WHERE NOT damaged AND id % 23 <> 0""",
)
def decode_frames(spark, d):
    # every 23rd capture is cut inside the port numbers
    text = F.when(F.col("id") % 23 == 0, F.substring(_frame_hex(), 1, 68)).otherwise(_frame_hex())
    df = _lines(spark, d).select("id", F.base64(F.unhex(text)).alias("data"))
    return frames.decode_frames(frames.captured_frames(df)).drop("data", "frame")


def _datagrams(spark, d, record: Column, build):
    """One datagram per order with the order's line items as records."""
    df = _lines(spark, d).select("l_orderkey", record.alias("r"))
    packed = df.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    exporter = F.concat(F.lit("192.0.2."), F.col("l_orderkey") % 5)
    return packed.select(
        "l_orderkey", exporter.alias("exporter"), F.unhex(build(F.col("l_orderkey"), F.col("rs"))).alias("datagram")
    )


_SECS, _UPTIME = 1_700_000_000, 5_000_000


def v5_datagrams(spark, d):
    record = F.concat(
        _ip_hex(10, F.col("l_suppkey")), _ip_hex(172, F.col("l_partkey")), F.lit("00" * 4), _hx(F.col("l_linenumber"), 2),
        _hx(F.col("l_linenumber") + 1, 2), _hx(F.col("pk"), 4), _hx(F.col("by"), 4), _hx(F.lit(_UPTIME - 4000) + F.col("l_linenumber"), 4),
        _hx(F.lit(_UPTIME - 1000) + F.col("l_linenumber"), 4), _hx(F.col("sport"), 2), _hx(F.col("dport"), 2), F.lit("00"),
        _hx(F.col("l_linenumber") * 9, 1), _hx(F.col("proto"), 1), F.lit("00"), _hx(F.col("l_suppkey") % 100, 2), _hx(F.col("l_partkey") % 100, 2),
        F.lit("18180000"),
    )

    def build(order, rs):
        # the header claims one record more than is there
        head = F.concat(F.lit("0005"), _hx(F.size(rs) + 1, 2), _hx(F.lit(_UPTIME), 4), _hx(F.lit(_SECS) + order % 1000, 4), F.lit("00" * 8), F.lit("0307"), F.lit("0000"))
        return F.concat(head, F.array_join(rs, ""), F.lit("ABCD"))

    return _datagrams(spark, d, record, build)


def _export_sql(engine_type: str, engine_id: str, extra: str = "") -> str:
    return f"""WITH {_LINE_SQL}
SELECT {extra} src AS src_ip, dst AS dst_ip, sport AS src_port, dport AS dst_port, proto AS protocol, pk AS packets, nb AS bytes,
  '192.0.2.' || (l_orderkey % 5) AS exporter_ip, {engine_type} AS engine_type, {engine_id} AS engine_id"""


_EXPORT_COLS = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packets", "bytes", "exporter_ip", "engine_type", "engine_id")


@query(
    "decode_netflow_v5",
    _export_sql("3", "7", "l_orderkey,")
    + f""", CAST(l_linenumber AS BIGINT) AS input_snmp, CAST(l_linenumber + 1 AS BIGINT) AS output_snmp, CAST(l_linenumber * 9 AS INTEGER) AS tcp_flags,
  l_suppkey % 100 AS src_as, l_partkey % 100 AS dst_as, {_SECS} + l_orderkey % 1000 - (4000 - l_linenumber) / CAST(1000 AS DOUBLE) AS flow_start,
  {_SECS} + l_orderkey % 1000 - (1000 - l_linenumber) / CAST(1000 AS DOUBLE) AS flow_end FROM li""",
)
def decode_netflow_v5(spark, d):
    return netflow.decode_netflow_v5(v5_datagrams(spark, d)).drop("vendor_props")


# field numbers and sizes of the two templates exporters use
_SPEC = {
    256: [(8, 4), (12, 4), (7, 2), (11, 2), (4, 1), (2, 4), (1, 4), (22, 4), (21, 4), (6, 1), (10, 2)],
    257: [(12, 4), (8, 4), (10, 2), (99, 3), (11, 2), (7, 2), (1, 4), (2, 4), (21, 4), (22, 4), (4, 1), (6, 1)],
}


def _field_hex(ftype: int, flen: int) -> Column:
    value = {
        8: _ip_hex(10, F.col("l_suppkey")), 12: _ip_hex(172, F.col("l_partkey")), 7: _hx(F.col("sport"), 2),
        11: _hx(F.col("dport"), 2), 4: _hx(F.col("proto"), 1), 2: _hx(F.col("pk"), 4), 1: _hx(F.col("by"), 4),
        22: _hx(F.lit(_UPTIME - 4000) + F.col("l_linenumber"), 4), 21: _hx(F.lit(_UPTIME - 1000) + F.col("l_linenumber"), 4),
        6: _hx(F.col("l_linenumber") * 9, 1), 10: _hx(F.col("l_linenumber"), 2),
    }.get(ftype)
    return value if value is not None else F.lit("EE" * flen)


def _template_hex(tid: int, enterprise: bool) -> str:
    words = []
    for ftype, flen in _SPEC[tid]:
        private = enterprise and ftype == 99
        words.append(f"{ftype | (0x8000 if private else 0):04X}{flen:04X}" + ("0000ABCD" if private else ""))
    return f"{tid:04X}{len(_SPEC[tid]):04X}" + "".join(words)


def _templated_datagrams(spark, d, version: int):
    tid = F.when(F.col("l_orderkey") % 2 == 0, 256).otherwise(257)
    by_template = {t: F.concat(*[_field_hex(*f) for f in _SPEC[t]]) for t in _SPEC}
    record = F.when(tid == 256, by_template[256]).otherwise(by_template[257])

    def build(order, rs):
        tpl = F.when(tid == 256, _template_hex(256, version == 10)).otherwise(_template_hex(257, version == 10))
        set_id = "0000" if version == 9 else "0002"
        tset = F.concat(F.lit(set_id), _hx(F.length(tpl) / 2 + 4, 2), tpl)
        body = F.array_join(rs, "")
        dset = F.concat(_hx(tid, 2), _hx(F.length(body) / 2 + 4 + 2, 2), body, F.lit("0000"))
        secs = _hx(F.lit(_SECS) + order, 4)
        if version == 9:
            head = F.concat(F.lit("0009"), F.lit("0002"), _hx(F.lit(_UPTIME), 4), secs, F.lit("00" * 4), F.lit("00050009"))
        else:
            head = F.concat(F.lit("000A"), F.lit("0000"), secs, F.lit("00" * 4), F.lit("00050009"))
        options = F.lit("0003000800000000") if version == 10 else F.lit("")
        return F.concat(head, tset, options, dset)

    return _datagrams(spark, d, record, build)


_FLAGS = """, CAST(l_linenumber * 9 AS INTEGER) AS tcp_flags, CAST(l_linenumber AS BIGINT) AS input_snmp"""


@query(
    "decode_netflow_v9",
    _export_sql("5", "9", "l_orderkey,")
    + _FLAGS
    + f""", {_SECS} + l_orderkey - (4000 - l_linenumber) / CAST(1000 AS DOUBLE) AS flow_start,
  {_SECS} + l_orderkey - (1000 - l_linenumber) / CAST(1000 AS DOUBLE) AS flow_end FROM li""",
)
def decode_netflow_v9(spark, d):
    out = netflow.decode_netflow_v9(_templated_datagrams(spark, d, 9))
    return out.select("l_orderkey", *_EXPORT_COLS, "tcp_flags", "input_snmp", "flow_start", "flow_end")


@query(
    "decode_ipfix",
    _export_sql("5", "9", "l_orderkey,") + _FLAGS + f", CAST({_SECS} + l_orderkey AS DOUBLE) AS flow_start FROM li",
)
def decode_ipfix(spark, d):
    out = netflow.decode_ipfix(_templated_datagrams(spark, d, 10))
    return out.select("l_orderkey", *_EXPORT_COLS, "tcp_flags", "input_snmp", "flow_start")


@query(
    "netflow_templates",
    f"""SELECT DISTINCT '192.0.2.' || (l_orderkey % 5) AS exporter, CAST(CASE WHEN l_orderkey % 2 = 0 THEN 256 ELSE 257 END AS INTEGER) AS template_id,
  {_SECS * 1_000_000} + l_orderkey * 1000000 AS seen_us, CASE WHEN l_orderkey % 2 = 0 THEN '{','.join(f'{a}:{b}' for a, b in _SPEC[256])}'
    ELSE '{','.join(f'{a}:{b}' for a, b in _SPEC[257])}' END AS spec FROM lineitem""",
)
def netflow_templates(spark, d):
    out = netflow.netflow_v9_templates(_templated_datagrams(spark, d, 9))
    text = F.array_join(F.transform("spec", lambda f: F.concat(f["ftype"], F.lit(":"), f["flen"])), ",")
    return out.withColumn("spec", text)


@query(
    "decode_sflow",
    f"""WITH {_LINE_SQL}
SELECT l_orderkey, src AS src_ip, dst AS dst_ip, sport AS src_port, dport AS dst_port, proto AS protocol, CAST(1 AS BIGINT) AS packets, nb AS bytes,
  CAST(l_linenumber AS BIGINT) AS input_snmp, '192.0.2.' || (l_orderkey % 5) AS exporter_ip, '10.1.2.3' AS agent FROM li WHERE NOT damaged""",
)
def decode_sflow(spark, d):
    frame = _frame_hex()
    size = F.length(frame) / 2
    header = F.concat(F.lit("00000001"), _hx(F.col("by"), 4), F.lit("00000000"), _hx(size, 4), frame, F.repeat(F.lit("00"), ((4 - size % 4) % 4).cast("int")))
    raw = F.concat(F.lit("00000001"), _hx(F.length(header) / 2, 4), header)
    skipped = F.lit("000003E9" + "00000004" + "DEADBEEF")
    body = F.concat(F.lit("00" * 20), _hx(F.col("l_linenumber"), 4), F.lit("00000000"), F.lit("00000002"), skipped, raw)
    sample = F.concat(F.lit("00000001"), _hx(F.length(body) / 2, 4), body)

    def build(order, rs):
        counter = F.lit("00000002" + "00000008" + "00" * 8)
        return F.concat(F.lit("00000005" + "00000001" + "0A010203" + "00" * 12), _hx(F.size(rs) + 1, 4), counter, F.array_join(rs, ""))

    out = netflow.decode_sflow(_datagrams(spark, d, sample, build))
    return out.select(
        "l_orderkey", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packets", "bytes", "input_snmp", "exporter_ip",
        F.col("vendor_props")["sflow_agent"].alias("agent"),
    )


@query(
    "asof_templates",
    """WITH t AS (SELECT 'e' || (o_custkey % 5) AS exporter, CAST(o_custkey % 3 AS INTEGER) AS template_id, epoch_us(o_orderdate) AS seen_us,
    max(o_custkey % 2) AS v FROM orders GROUP BY ALL),
r AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_extendedprice, 'e' || (l_suppkey % 5) AS exporter, CAST(l_partkey % 3 AS INTEGER) AS template_id, epoch_us(l_shipdate) AS ts_us FROM lineitem)
SELECT r.id, r.l_extendedprice, r.exporter, r.template_id, r.ts_us, CAST(t.v AS INTEGER) AS flen FROM r ASOF JOIN t
  ON r.exporter = t.exporter AND r.template_id = t.template_id AND r.ts_us >= t.seen_us WHERE r.ts_us - t.seen_us <= 864000000000""",
)
def asof_templates(spark, d):
    orders = table(spark, d, "orders")
    spec = F.array(F.struct(F.lit(8).alias("ftype"), (F.col("o_custkey") % 2).cast("int").alias("flen")))
    templates = orders.select(
        F.concat(F.lit("e"), F.col("o_custkey") % 5).alias("exporter"), (F.col("o_custkey") % 3).cast("int").alias("template_id"),
        spec.alias("spec"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("seen_us"),
    )
    data = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        "l_extendedprice",
        F.concat(F.lit("e"), F.col("l_suppkey") % 5).alias("exporter"),
        (F.col("l_partkey") % 3).cast("int").alias("template_id"),
        F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("ts_us"),
    )
    out = netflow.asof_templates(data, templates, 864_000)
    return out.select("id", "l_extendedprice", "exporter", "template_id", "ts_us", F.get("spec", F.lit(0))["flen"].alias("flen"))
