"""Registered flow queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.functions import keys as K
from flowspark.functions import packets as P
from flowspark.operators import flows as O
from flowspark.plans import views as V
from flowspark.plans.catalog import q4, query, sql_q4, table
from flowspark.session import stored

_BASIC = (
    "flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "start_time", "duration",
    "packets_total", "bytes_total", "packets_fwd", "packets_rev", "bytes_fwd", "bytes_rev",
    "packets_per_sec", "bytes_per_sec", "avg_pkt_size", "min_pkt_size", "max_pkt_size",
    "fwd_rev_packet_ratio", "fwd_rev_byte_ratio", "tcp_syn_count", "tcp_ack_count", "tcp_fin_count",
    "tcp_rst_count", "tcp_psh_count", "tcp_urg_count", "dns_query_count", "dns_unique_domains",
    "http_request_count", "http_unique_hosts", "tls_handshake_count", "tls_unique_sni",
)


def _shown(df):
    return df.select(
        *_BASIC, q4("pkt_size_std").alias("pkt_size_std"), q4("payload_entropy").alias("payload_entropy")
    )


def _sessions_sql(timeout_us: int | None) -> str:
    if timeout_us is None:
        return "sess AS (SELECT *, min(ts_us) OVER (PARTITION BY flow_id) AS session_us FROM canon)"
    return f"""
marked AS (
  SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY flow_id ORDER BY ts_us, packet_number) AS gap FROM canon
),
sess AS (
  SELECT *, max(CASE WHEN gap IS NULL OR gap > {timeout_us} THEN ts_us END)
    OVER (PARTITION BY flow_id ORDER BY ts_us, packet_number) AS session_us
  FROM marked
)"""


def _flag(bit: int) -> str:
    return f"count(*) FILTER (WHERE tcp_flags & {bit} <> 0)"


def _basic_sql(view: str, timeout_us: int | None, payload: bool) -> str:
    app = (
        """
    count(*) FILTER (WHERE (src_port = 53 OR dst_port = 53) AND length(phex) >= 24 AND substr(phex, 5, 4) = '0100') AS dns_n,
    count(DISTINCT substr(phex, 1, 128)) FILTER (WHERE (src_port = 53 OR dst_port = 53) AND length(phex) >= 24 AND substr(phex, 5, 4) = '0100') AS dns_u,
    count(*) FILTER (WHERE dst_port IN (80, 8080, 8000) AND ptext IS NOT NULL) AS http_n,
    count(DISTINCT regexp_extract(ptext, 'Host: ([^\\r]*)', 1)) FILTER (WHERE dst_port IN (80, 8080, 8000) AND ptext IS NOT NULL) AS http_u,
    count(*) FILTER (WHERE dst_port = 443 AND substr(phex, 1, 2) = '16') AS tls_n,
    arg_min(substr(phex, 1, 512), (ts_us, packet_number)) FILTER (WHERE phex <> '') AS sample
    """
        if payload
        else "0 AS dns_n, 0 AS dns_u, 0 AS http_n, 0 AS http_u, 0 AS tls_n, CAST(NULL AS VARCHAR) AS sample"
    )
    return f"""
WITH {view}, {_sessions_sql(timeout_us)},
agg AS (
  SELECT flow_id, session_us, any_value(ip1) AS ip1, any_value(ip2) AS ip2, any_value(port1) AS port1,
    any_value(port2) AS port2, any_value(protocol) AS protocol, min(ts_us) AS t0, max(ts_us) AS t1,
    count(*) AS n, CAST(sum(length) AS BIGINT) AS s, count(*) FILTER (WHERE fwd) AS pf, count(*) FILTER (WHERE NOT fwd) AS pr,
    CAST(coalesce(sum(length) FILTER (WHERE fwd), 0) AS BIGINT) AS bf,
    CAST(coalesce(sum(length) FILTER (WHERE NOT fwd), 0) AS BIGINT) AS br,
    min(length) AS mn, max(length) AS mx, stddev_pop(length) AS sd,
    {_flag(2)} AS syn, {_flag(16)} AS ack, {_flag(1)} AS fin, {_flag(4)} AS rst, {_flag(8)} AS psh, {_flag(32)} AS urg,
    {app}
  FROM sess GROUP BY flow_id, session_us
),
dur AS (SELECT *, greatest((t1 - t0) / CAST(1e6 AS DOUBLE), CAST(0.001 AS DOUBLE)) AS d FROM agg),
syms AS (
  SELECT flow_id, session_us, count(*) AS c, sum(count(*)) OVER (PARTITION BY flow_id, session_us) AS tot
  FROM (SELECT flow_id, session_us, unnest(range(0, length(sample) // 2)) AS i, sample FROM dur WHERE sample IS NOT NULL)
  GROUP BY flow_id, session_us, substr(sample, i * 2 + 1, 2)
),
ent AS (SELECT flow_id, session_us, -sum(c / CAST(tot AS DOUBLE) * log2(c / CAST(tot AS DOUBLE))) AS e FROM syms GROUP BY ALL)
SELECT dur.flow_id, ip1 AS src_ip, ip2 AS dst_ip, port1 AS src_port, port2 AS dst_port, protocol,
  t0 / CAST(1e6 AS DOUBLE) AS start_time, d AS duration, n AS packets_total, s AS bytes_total,
  pf AS packets_fwd, pr AS packets_rev, bf AS bytes_fwd, br AS bytes_rev, n / d AS packets_per_sec,
  s / d AS bytes_per_sec, s / n AS avg_pkt_size, mn AS min_pkt_size, mx AS max_pkt_size,
  pf / greatest(pr, 1) AS fwd_rev_packet_ratio, bf / greatest(br, 1) AS fwd_rev_byte_ratio,
  syn AS tcp_syn_count, ack AS tcp_ack_count, fin AS tcp_fin_count, rst AS tcp_rst_count,
  psh AS tcp_psh_count, urg AS tcp_urg_count, dns_n AS dns_query_count, dns_u AS dns_unique_domains,
  http_n AS http_request_count, http_u AS http_unique_hosts, tls_n AS tls_handshake_count,
  least(tls_n, 1) AS tls_unique_sni, {sql_q4('sd')} AS pkt_size_std, {sql_q4('abs(coalesce(e, 0))')} AS payload_entropy
FROM dur LEFT JOIN ent ON dur.flow_id = ent.flow_id AND dur.session_us = ent.session_us
"""


@query("flow_features", _basic_sql(V.PACKETS_SQL, None, True))
def flow_features(spark, d):
    return _shown(O.flow_features(V.packets(spark, d)))


@query("flow_sessions", _basic_sql(V.PACKETS_SQL, 300_000_000, True))
def flow_sessions(spark, d):
    return _shown(O.flow_sessions(V.packets(spark, d)))


@query("flow_sessions_1d", _basic_sql(V.PACKETS_SQL, 86_400_000_000, True))
def flow_sessions_1d(spark, d):
    return _shown(O.flow_sessions(V.packets(spark, d), 86_400))


@query("bulk_flow_features", _basic_sql(V.BULK_PACKETS_SQL, None, False))
def bulk_flow_features(spark, d):
    return _shown(O.flow_features(V.bulk_packets(spark, d)))


@query("bulk_flow_sessions", _basic_sql(V.BULK_PACKETS_SQL, 604_800_000_000, False))
def bulk_flow_sessions(spark, d):
    # stored steps, so that what was shuffled for one is gone before the next
    return _shown(O.flow_sessions(stored(V.bulk_packets(spark, d), "packets"), 604_800, keep=stored))


# --- the 51-feature vector ------------------------------------------------------
_STD = ("fwd_packet_len_std", "bwd_packet_len_std", "fwd_iat_mean", "bwd_iat_mean", "fwd_iat_std",
        "bwd_iat_std", "active_mean", "active_std", "idle_mean", "idle_std")


def _side_sql(out: str, cond: str) -> str:
    f = f"FILTER (WHERE {cond})"
    return f"""
    count(*) {f} AS {out}_packets, CAST(coalesce(sum(length) {f}, 0) AS BIGINT) AS {out}_bytes,
    CAST(coalesce(sum(plen) {f}, 0) AS BIGINT) AS {out}_payload_bytes,
    CAST(coalesce(max(length) {f}, 0) AS DOUBLE) AS {out}_packet_len_max,
    CAST(coalesce(min(length) {f}, 0) AS DOUBLE) AS {out}_packet_len_min,
    coalesce(avg(length) {f}, 0) AS {out}_packet_len_mean, coalesce(stddev_pop(length) {f}, 0) AS {out}_packet_len_std,
    coalesce((max(ts_us) {f} - min(ts_us) {f}) / CAST(1e6 AS DOUBLE), 0) AS {out}_iat_total,
    coalesce(avg(iat) {f}, 0) AS {out}_iat_mean, coalesce(stddev_pop(iat) {f}, 0) AS {out}_iat_std,
    coalesce(max(iat) {f}, 0) AS {out}_iat_max, coalesce(min(iat) {f}, 0) AS {out}_iat_min,
    CAST(coalesce(arg_min(win, (ts_us, packet_number)) FILTER (WHERE {cond} AND win IS NOT NULL), 0) AS BIGINT) AS init_{out}_win_bytes"""


def _vector_sql(timeout_us: int) -> str:
    from flowspark.schemas import FEATURES

    flags = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16, "urg": 32, "ece": 64, "cwr": 128}
    exact = [f for f in FEATURES if f not in _STD]
    return f"""
WITH {V.PACKETS_SQL}, {_sessions_sql(timeout_us)},
dirs AS (
  SELECT *, length(phex) // 2 AS plen, first_value(fwd) OVER w AS fwd0, fwd = fwd0 AS forward,
    ts_us - lag(ts_us) OVER w AS g
  FROM sess WINDOW w AS (PARTITION BY flow_id, session_us ORDER BY ts_us, packet_number)
),
iats AS (
  SELECT *, (ts_us - lag(ts_us) OVER (PARTITION BY flow_id, session_us, forward ORDER BY ts_us, packet_number)) / CAST(1e6 AS DOUBLE) AS iat,
    sum(CASE WHEN g > 5000000 THEN 1 ELSE 0 END) OVER (PARTITION BY flow_id, session_us ORDER BY ts_us, packet_number) AS period
  FROM dirs
),
act AS (
  SELECT flow_id, session_us, avg(a) AS active_mean, stddev_pop(a) AS active_std, max(a) AS active_max, min(a) AS active_min
  FROM (SELECT flow_id, session_us, period, (max(ts_us) - min(ts_us)) / CAST(1e6 AS DOUBLE) AS a FROM iats GROUP BY ALL) GROUP BY ALL
),
agg AS (
  SELECT flow_id, session_us, greatest((max(ts_us) - min(ts_us)) / CAST(1e6 AS DOUBLE), CAST(0.001 AS DOUBLE)) AS duration,
    {_side_sql('fwd', 'forward')}, {_side_sql('bwd', 'NOT forward')},
    {', '.join(f'{_flag(b)} AS {n}_flag_count' for n, b in flags.items())},
    1 + count(*) FILTER (WHERE g > 1000000) AS subflows,
    coalesce(avg(g / CAST(1e6 AS DOUBLE)) FILTER (WHERE g > 5000000), 0) AS idle_mean,
    coalesce(stddev_pop(g / CAST(1e6 AS DOUBLE)) FILTER (WHERE g > 5000000), 0) AS idle_std,
    coalesce(max(g / CAST(1e6 AS DOUBLE)) FILTER (WHERE g > 5000000), 0) AS idle_max,
    coalesce(min(g / CAST(1e6 AS DOUBLE)) FILTER (WHERE g > 5000000), 0) AS idle_min,
    arg_min(src_ip || ':' || src_port || '->' || dst_ip || ':' || dst_port || '/' || protocol, (ts_us, packet_number)) AS flow_key
  FROM iats GROUP BY flow_id, session_us
),
full_ AS (
  SELECT agg.*, act.* EXCLUDE (flow_id, session_us),
    fwd_packets / duration AS fwd_packets_per_sec, bwd_packets / duration AS bwd_packets_per_sec,
    fwd_bytes / duration AS fwd_bytes_per_sec, bwd_bytes / duration AS bwd_bytes_per_sec,
    fwd_packets // subflows AS subflow_fwd_packets, fwd_bytes // subflows AS subflow_fwd_bytes,
    bwd_packets // subflows AS subflow_bwd_packets, bwd_bytes // subflows AS subflow_bwd_bytes
  FROM agg JOIN act ON agg.flow_id = act.flow_id AND agg.session_us = act.session_us
)
SELECT flow_id, flow_key, session_us / CAST(1e6 AS DOUBLE) AS "timestamp",
  {', '.join(exact)}, {', '.join(f'{sql_q4(f)} AS {f}' for f in _STD)}
FROM full_
"""


@query("flow_vector51", _vector_sql(86_400_000_000))
def flow_vector51(spark, d):
    from flowspark.schemas import FEATURES

    df = O.flow_vector51(V.packets(spark, d), 86_400)
    exact = [f for f in FEATURES if f not in _STD]
    return df.select("flow_id", "flow_key", "timestamp", *exact, *[q4(f).alias(f) for f in _STD])


@query(
    "inter_arrival",
    f"""WITH {V.PACKETS_SQL}
SELECT flow_id, packet_number, fwd AS forward,
  (ts_us - lag(ts_us) OVER (PARTITION BY flow_id, fwd ORDER BY ts_us, packet_number)) / CAST(1e6 AS DOUBLE) AS iat_s
FROM canon""",
)
def inter_arrival(spark, d):
    return O.inter_arrival(V.packets(spark, d)).select("flow_id", "packet_number", "forward", "iat_s")


@query(
    "active_idle",
    f"""WITH {V.PACKETS_SQL},
g AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY flow_id ORDER BY ts_us, packet_number) AS gap FROM canon),
p AS (SELECT *, sum(CASE WHEN gap > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY flow_id ORDER BY ts_us, packet_number) AS k FROM g)
SELECT flow_id, min(ts_us) AS period_us, count(*) AS packets, (max(ts_us) - min(ts_us)) / CAST(1e6 AS DOUBLE) AS active_s,
  max(CASE WHEN gap > 3600000000 THEN gap END) / CAST(1e6 AS DOUBLE) AS idle_before_s
FROM p GROUP BY flow_id, k""",
)
def active_idle(spark, d):
    return O.active_idle(V.packets(spark, d), 3600)


_MATCH = f"""WITH {V.EXPORTS_SQL},
m AS (
  SELECT flow_id, any_value(ip1) AS ip1, any_value(ip2) AS ip2, any_value(port1) AS port1, any_value(port2) AS port2,
    any_value(protocol) AS protocol, min(flow_start) AS flow_start, max(flow_end) AS flow_end,
    count(*) FILTER (WHERE fwd) AS fwd_records, count(*) FILTER (WHERE NOT fwd) AS rev_records,
    CAST(coalesce(sum(packets) FILTER (WHERE fwd), 0) AS BIGINT) AS fwd_packets,
    CAST(coalesce(sum(packets) FILTER (WHERE NOT fwd), 0) AS BIGINT) AS rev_packets,
    CAST(coalesce(sum(bytes) FILTER (WHERE fwd), 0) AS BIGINT) AS fwd_bytes,
    CAST(coalesce(sum(bytes) FILTER (WHERE NOT fwd), 0) AS BIGINT) AS rev_bytes, bit_or(tcp_flags) AS tcp_flags
  FROM exports GROUP BY flow_id
)"""


@query(
    "match_bidirectional",
    _MATCH + " SELECT *, fwd_records > 0 AND rev_records > 0 AS matched FROM m",
)
def match_bidirectional(spark, d):
    return O.match_bidirectional(V.flow_exports(spark, d)).withColumn("flow_id", K.flow_id())


@query(
    "export_features",
    _MATCH
    + """, x AS (SELECT *, greatest(flow_end - flow_start, CAST(0.001 AS DOUBLE)) AS d FROM m)
SELECT flow_id, ip1 AS src_ip, ip2 AS dst_ip, port1 AS src_port, port2 AS dst_port, protocol, flow_start AS start_time,
  d AS duration, fwd_packets + rev_packets AS packets_total, fwd_bytes + rev_bytes AS bytes_total,
  fwd_packets AS packets_fwd, rev_packets AS packets_rev, fwd_bytes AS bytes_fwd, rev_bytes AS bytes_rev,
  (fwd_packets + rev_packets) / d AS packets_per_sec, (fwd_bytes + rev_bytes) / d AS bytes_per_sec,
  (fwd_bytes + rev_bytes) / greatest(fwd_packets + rev_packets, 1) AS avg_pkt_size,
  fwd_packets / greatest(rev_packets, 1) AS fwd_rev_packet_ratio, fwd_bytes / greatest(rev_bytes, 1) AS fwd_rev_byte_ratio
FROM x""",
)
def export_features(spark, d):
    return O.export_features(V.flow_exports(spark, d))


_NAMES = ("FIN", "SYN", "RST", "PSH", "ACK", "URG", "ECE", "CWR")


@query(
    "flow_keys",
    f"""WITH {V.PACKETS_SQL}
SELECT packet_number, src_ip || ':' || src_port || '->' || dst_ip || ':' || dst_port || '/' || protocol AS directed,
  dst_ip || ':' || dst_port || '->' || src_ip || ':' || src_port || '/' || protocol AS reversed, flow_id, fwd AS forward,
  CASE protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' END AS proto_name,
  CASE protocol WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' END AS proto_ecs,
  concat_ws(',', {', '.join(f"CASE WHEN tcp_flags & {1 << i} <> 0 THEN '{n}' END" for i, n in enumerate(_NAMES))}) AS flag_names,
  src_ip AS stripped FROM canon""",
)
def flow_keys(spark, d):
    df = K.canonical_flow(V.packets(spark, d))
    return df.select(
        "packet_number",
        K.directed_key().alias("directed"),
        K.reverse_key().alias("reversed"),
        K.flow_id().alias("flow_id"),
        K.is_forward().alias("forward"),
        K.protocol_name("protocol").alias("proto_name"),
        K.protocol_name("protocol", "ecs").alias("proto_ecs"),
        F.array_join(K.tcp_flag_names("tcp_flags"), ",").alias("flag_names"),
        K.strip_mapped_ipv4(F.concat(F.lit("::ffff:"), F.col("src_ip"))).alias("stripped"),
    )


@query(
    "app_layer_tags",
    f"""WITH {V.PACKETS_SQL}
SELECT packet_number,
  CASE WHEN (src_port = 53 OR dst_port = 53) AND length(phex) >= 24 AND substr(phex, 5, 4) = '0100' THEN substr(phex, 1, 128) END AS dns_query,
  CASE WHEN dst_port IN (80, 8080, 8000) AND ptext IS NOT NULL THEN regexp_extract(ptext, 'Host: ([^\\r]*)', 1) END AS http_host,
  CASE WHEN dst_port = 443 AND substr(phex, 1, 2) = '16' THEN 'handshake' END AS tls
FROM packets""",
)
def app_layer_tags(spark, d):
    df = P.tag_app_layer(V.packets(spark, d))
    return df.select("packet_number", F.hex("dns_query").alias("dns_query"), "http_host", "tls")


@query(
    "payload_entropy",
    f"""WITH h AS (SELECT doc_id, hex(encode(text)) AS x FROM documents),
b AS (SELECT doc_id, unnest(range(0, length(x) // 2)) AS i, x FROM h),
s AS (SELECT doc_id, substr(x, i * 2 + 1, 2) AS byte, count(*) AS c FROM b GROUP BY ALL),
t AS (SELECT *, sum(c) OVER (PARTITION BY doc_id) AS tot FROM s),
e AS (SELECT doc_id, -sum(c / CAST(tot AS DOUBLE) * log2(c / CAST(tot AS DOUBLE))) AS bits FROM t GROUP BY doc_id)
SELECT d.doc_id, {sql_q4('abs(coalesce(bits, 0))')} AS entropy FROM documents d LEFT JOIN e ON d.doc_id = e.doc_id""",
)
def payload_entropy(spark, d):
    docs = table(spark, d, "documents")
    body = F.encode("text", "UTF-8")
    return docs.select("doc_id", q4(P.payload_entropy(body, None)).alias("entropy"))
