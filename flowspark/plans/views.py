"""Record views over the given tables, each with the same view as SQL.

Packets, detections, flow exports and raw log text are derived from ``events`` and
``lineitem`` by fixed formulas, so their volume grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.functions.keys import directed_key
from flowspark.plans.catalog import dealt, table

CRLF = "\r\n"


def _ip(prefix: str, n: Column) -> Column:
    return F.concat(
        F.lit(prefix),
        F.floor(n / 65536) % 256, F.lit("."),
        F.floor(n / 256) % 256, F.lit("."),
        n % 256,
    )


def _sql_ip(prefix: str, n: str) -> str:
    return f"'{prefix}' || (({n}) // 65536 % 256) || '.' || (({n}) // 256 % 256) || '.' || (({n}) % 256)"


def _ends(df: DataFrame) -> DataFrame:
    uid, eid, kind = F.col("user_id"), F.col("event_id"), F.col("event_type")
    port = (
        F.when(kind == "view", 80)
        .when(kind == "click", 443)
        .when(kind == "purchase", 53)
        .when(kind == "error", 22)
        .otherwise(8080)
    )
    return df.withColumns(
        {
            "ts_us": F.unix_micros(F.col("ts").cast("timestamp")),
            "host": _ip("10.", uid),
            "peer": F.concat(F.lit("192.168.0."), eid % 2),
            "hport": (F.lit(40000) + uid % 4).cast("int"),
            "pport": port,
            "outward": F.floor(eid / 2) % 2 == 0,
            "protocol": F.when(kind == "purchase", 17).otherwise(6),
        }
    )


def _oriented(a: str, b: str) -> Column:
    return F.when(F.col("outward"), F.col(a)).otherwise(F.col(b))


_ENDS_SQL = f"""
  SELECT *, epoch_us(ts) AS ts_us, {_sql_ip('10.', 'user_id')} AS host,
    '192.168.0.' || (event_id % 2) AS peer, CAST(40000 + user_id % 4 AS INTEGER) AS hport,
    CASE event_type WHEN 'view' THEN 80 WHEN 'click' THEN 443 WHEN 'purchase' THEN 53
      WHEN 'error' THEN 22 ELSE 8080 END AS pport,
    (event_id // 2) % 2 = 0 AS outward, CASE WHEN event_type = 'purchase' THEN 17 ELSE 6 END AS protocol
  FROM events"""

_ORIENT_SQL = """
    CASE WHEN outward THEN host ELSE peer END AS src_ip,
    CASE WHEN outward THEN peer ELSE host END AS dst_ip,
    CASE WHEN outward THEN hport ELSE pport END AS src_port,
    CASE WHEN outward THEN pport ELSE hport END AS dst_port"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One packet per event."""
    df = _ends(table(spark, sf_dir, "events"))
    uid, eid, kind = F.col("user_id"), F.col("event_id"), F.col("event_type")
    http = F.when(
        kind == "view", F.concat(F.lit("GET /p HTTP/1.1" + CRLF + "Host: h"), uid % 5, F.lit(".example" + CRLF))
    ).when(
        kind == "signup", F.concat(F.lit("POST /s HTTP/1.1" + CRLF + "Host: s"), uid % 3, F.lit(".example" + CRLF))
    )
    binary = (
        F.when(kind == "click", F.concat(F.lit("160301"), F.hex(F.col("props"))))
        .when(kind == "purchase", F.concat(F.lit("ABCD01000001000000000000"), F.hex(F.concat(F.lit("q"), uid % 7))))
        .otherwise("")
    )
    return df.select(
        "ts_us",
        _oriented("host", "peer").alias("src_ip"),
        _oriented("peer", "host").alias("dst_ip"),
        _oriented("hport", "pport").alias("src_port"),
        _oriented("pport", "hport").alias("dst_port"),
        "protocol",
        (F.lit(64) + F.floor("value")).cast("int").alias("length"),
        F.coalesce(F.encode(http, "UTF-8"), F.unhex(binary)).alias("payload"),
        F.lit("events").alias("pcap_file"),
        eid.alias("packet_number"),
        (eid % 64).cast("int").alias("tcp_flags"),
        F.when(kind != "purchase", (eid % 1000).cast("int")).alias("window"),
        F.lit(None).cast("int").alias("payload_len"),
    )


PACKETS_SQL = f"""
packets AS (
  SELECT ts_us, {_ORIENT_SQL}, protocol, CAST(64 + floor(value) AS INTEGER) AS length,
    CASE event_type
      WHEN 'view' THEN 'GET /p HTTP/1.1' || chr(13) || chr(10) || 'Host: h' || (user_id % 5) || '.example' || chr(13) || chr(10)
      WHEN 'signup' THEN 'POST /s HTTP/1.1' || chr(13) || chr(10) || 'Host: s' || (user_id % 3) || '.example' || chr(13) || chr(10)
    END AS ptext,
    CASE event_type
      WHEN 'click' THEN '160301' || hex(props)
      WHEN 'purchase' THEN 'ABCD01000001000000000000' || hex('q' || (user_id % 7))
      ELSE '' END AS pbin,
    coalesce(hex(ptext), pbin) AS phex, event_id AS packet_number,
    CAST(event_id % 64 AS INTEGER) AS tcp_flags,
    CASE WHEN event_type <> 'purchase' THEN CAST(event_id % 1000 AS INTEGER) END AS win
  FROM ({_ENDS_SQL})
),
canon AS (
  SELECT *, src_ip < dst_ip AS kept,
    CASE WHEN src_ip < dst_ip THEN src_ip ELSE dst_ip END AS ip1,
    CASE WHEN src_ip < dst_ip THEN dst_ip ELSE src_ip END AS ip2,
    CASE WHEN src_ip < dst_ip THEN src_port ELSE dst_port END AS port1,
    CASE WHEN src_ip < dst_ip THEN dst_port ELSE src_port END AS port2,
    ip1 || ':' || port1 || '-' || ip2 || ':' || port2 || '-' || protocol AS flow_id,
    (src_ip = ip1 AND src_port = port1) AS fwd
  FROM packets
)"""


def bulk_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One packet per line item between a supplier host and a part host."""
    line = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")
    supp, part = F.col("l_suppkey"), F.col("l_partkey")
    host, peer = _ip("10.", supp), _ip("172.", part % 97)
    outward = F.col("l_returnflag") != "R"
    sport, dport = (F.lit(40000) + supp % 3).cast("int"), F.when(F.col("l_linestatus") == "O", 443).otherwise(80)
    ts = F.unix_micros(F.col("l_shipdate").cast("timestamp")) + F.col("l_linenumber") * F.lit(1000000).cast("long")
    return line.select(
        ts.alias("ts_us"),
        F.when(outward, host).otherwise(peer).alias("src_ip"),
        F.when(outward, peer).otherwise(host).alias("dst_ip"),
        F.when(outward, sport).otherwise(dport).alias("src_port"),
        F.when(outward, dport).otherwise(sport).alias("dst_port"),
        F.lit(6).alias("protocol"),
        (F.col("l_quantity") * 20).cast("int").alias("length"),
        F.lit(b"").alias("payload"),
        F.lit("lineitem").alias("pcap_file"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("packet_number"),
        F.col("l_linenumber").cast("int").alias("tcp_flags"),
        F.lit(None).cast("int").alias("window"),
        F.lit(None).cast("int").alias("payload_len"),
    )


BULK_PACKETS_SQL = f"""
bulk AS (
  SELECT epoch_us(l_shipdate) + l_linenumber * 1000000 AS ts_us,
    CASE WHEN outward THEN host ELSE peer END AS src_ip, CASE WHEN outward THEN peer ELSE host END AS dst_ip,
    CASE WHEN outward THEN sport ELSE dport END AS src_port, CASE WHEN outward THEN dport ELSE sport END AS dst_port,
    6 AS protocol, CAST(l_quantity * 20 AS INTEGER) AS length, CAST(l_linenumber AS INTEGER) AS tcp_flags,
    l_orderkey * 8 + l_linenumber AS packet_number
  FROM (SELECT *, {_sql_ip('10.', 'l_suppkey')} AS host, {_sql_ip('172.', 'l_partkey % 97')} AS peer,
          l_returnflag <> 'R' AS outward, CAST(40000 + l_suppkey % 3 AS INTEGER) AS sport,
          CASE WHEN l_linestatus = 'O' THEN 443 ELSE 80 END AS dport FROM lineitem)
),
canon AS (
  SELECT *,
    CASE WHEN src_ip < dst_ip THEN src_ip ELSE dst_ip END AS ip1,
    CASE WHEN src_ip < dst_ip THEN dst_ip ELSE src_ip END AS ip2,
    CASE WHEN src_ip < dst_ip THEN src_port ELSE dst_port END AS port1,
    CASE WHEN src_ip < dst_ip THEN dst_port ELSE src_port END AS port2,
    ip1 || ':' || port1 || '-' || ip2 || ':' || port2 || '-' || protocol AS flow_id,
    (src_ip = ip1 AND src_port = port1) AS fwd
  FROM bulk
)"""


def flow_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One one-way export record per bulk packet: its order of magnitude in packets and bytes."""
    df = bulk_packets(spark, sf_dir)
    start = F.col("ts_us") / F.lit(1e6)
    return df.select(
        start.alias("flow_start"),
        (start + F.col("tcp_flags")).alias("flow_end"),
        "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
        (F.col("tcp_flags") + 1).cast("long").alias("packets"),
        F.col("length").cast("long").alias("bytes"),
        "tcp_flags",
    )


EXPORTS_SQL = (
    BULK_PACKETS_SQL
    + """,
exports AS (
  SELECT *, ts_us / CAST(1e6 AS DOUBLE) AS flow_start, ts_us / CAST(1e6 AS DOUBLE) + tcp_flags AS flow_end,
    CAST(tcp_flags + 1 AS BIGINT) AS packets, CAST(length AS BIGINT) AS bytes
  FROM canon
)"""
)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detector output per event."""
    df = _ends(table(spark, sf_dir, "events"))
    kind, value, eid = F.col("event_type"), F.col("value"), F.col("event_id")
    alert_type = (
        F.when(kind == "error", "deep_path_lstm_ae")
        .when(kind == "purchase", "xgboost_supervised")
        .when(kind == "signup", "unknown")
        .otherwise("fast_path")
    )
    df = df.select(
        alert_type.alias("alert_type"),
        "ts_us",
        (F.col("ts_us") / F.lit(1e6)).alias("timestamp"),
        (value > 50).alias("is_anomaly"),
        _oriented("host", "peer").alias("src_ip"),
        _oriented("peer", "host").alias("dst_ip"),
        _oriented("hport", "pport").alias("src_port"),
        _oriented("pport", "hport").alias("dst_port"),
        "protocol",
        F.when(kind.isin("view", "click", "signup"), value / F.lit(500.0)).alias("anomaly_score"),
        F.when(kind == "error", value / F.lit(500.0)).alias("reconstruction_error"),
        F.when(kind == "purchase", value / F.lit(500.0)).alias("anomaly_probability"),
        F.when(eid % 7 != 0, F.concat(F.lit("v"), eid % 3)).alias("model_version"),
        (value / F.lit(10.0)).alias("inference_time_ms"),
        eid.alias("event_id"),
    )
    return df.withColumn("flow_key", directed_key())


DETECTIONS_SQL = f"""
detections AS (
  SELECT *, src_ip || ':' || src_port || '->' || dst_ip || ':' || dst_port || '/' || protocol AS flow_key
  FROM (
    SELECT CASE event_type WHEN 'error' THEN 'deep_path_lstm_ae' WHEN 'purchase' THEN 'xgboost_supervised'
        WHEN 'signup' THEN 'unknown' ELSE 'fast_path' END AS alert_type,
      ts_us, ts_us / CAST(1e6 AS DOUBLE) AS "timestamp", value > 50 AS is_anomaly, {_ORIENT_SQL}, protocol,
      CASE WHEN event_type IN ('view', 'click', 'signup') THEN value / CAST(500 AS DOUBLE) END AS anomaly_score,
      CASE WHEN event_type = 'error' THEN value / CAST(500 AS DOUBLE) END AS reconstruction_error,
      CASE WHEN event_type = 'purchase' THEN value / CAST(500 AS DOUBLE) END AS anomaly_probability,
      CASE WHEN event_id % 7 <> 0 THEN 'v' || (event_id % 3) END AS model_version,
      value / CAST(10 AS DOUBLE) AS inference_time_ms, event_id
    FROM ({_ENDS_SQL})
  )
)"""
