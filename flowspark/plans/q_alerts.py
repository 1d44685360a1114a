"""Registered alert queries: keys, enrichment, de-duplication, correlation, documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.functions import alerts as A
from flowspark.functions import scores as S
from flowspark.functions.times import iso
from flowspark.operators import alerts as O
from flowspark.operators import board as B
from flowspark.plans import views as V
from flowspark.plans.catalog import q4, query, sql_q4, table
from flowspark.plans.chain import alert_chain
from flowspark.session import stored

_SEVERITY = """CASE WHEN contains(alert_type, 'fast_path') THEN 'warning' WHEN contains(alert_type, 'deep_path') THEN 'error'
    WHEN contains(alert_type, 'xgboost_supervised') THEN 'critical' ELSE 'warning' END"""
_DEDUP = """substr(sha256('alert_type=' || alert_type || '|dst_ip=' || dst_ip || '|dst_port=' || dst_port || '|flow_key=' || flow_key
    || '|src_ip=' || src_ip || '|src_port=' || src_port), 1, 32)"""
_GROUP = "substr(sha256('flows=' || flow_key || '|ips=' || src_ip || '->' || dst_ip), 1, 16)"
_RISK = """CASE severity WHEN 'debug' THEN 0 WHEN 'info' THEN 10 WHEN 'notice' THEN 20 WHEN 'warning' THEN 40 WHEN 'error' THEN 60
    WHEN 'critical' THEN 80 WHEN 'alert' THEN 90 WHEN 'emergency' THEN 100 ELSE 40 END"""
_SCORE = "coalesce(nullif(anomaly_score, 0), nullif(reconstruction_error, 0), nullif(anomaly_probability, 0))"

ALERTS_SQL = f"""{V.DETECTIONS_SQL},
alerts AS (
  SELECT *, {_SEVERITY} AS severity, 'new' AS status,
    flow_key || '_' || CAST(trunc("timestamp" * 1000) AS BIGINT) AS alert_id,
    {_DEDUP} AS dedup_key, {_GROUP} AS group_id, 'alerts.' || {_SEVERITY} AS output_topic
  FROM detections
)"""


def alerts(spark, d):
    return O.prepare_alerts(V.detections(spark, d))


@query(
    "prepare_alerts",
    f"""WITH {ALERTS_SQL}
SELECT event_id, alert_id, severity, status, dedup_key, group_id, output_topic, {_RISK} AS risk,
  substr(sha256('{{"alert_type": "' || alert_type || '", "dst_ip": "' || dst_ip || '", "dst_port": ' || dst_port || ', "flow_key": "'
    || flow_key || '", "src_ip": "' || src_ip || '", "src_port": ' || src_port || '}}'), 1, 16) AS alert_hash
FROM alerts""",
)
def prepare_alerts(spark, d):
    return alerts(spark, d).select(
        "event_id", "alert_id", "severity", "status", "dedup_key", "group_id", "output_topic",
        S.risk_score("severity").alias("risk"), A.alert_hash().alias("alert_hash"),
    )


@query(
    "stix_indicators",
    f"""WITH {ALERTS_SQL}
SELECT event_id, CASE WHEN is_anomaly THEN 'indicator--' || flow_key END AS id,
  CASE WHEN is_anomaly THEN '[ipv4-addr:value = ''' || src_ip || '''] OR [ipv4-addr:value = ''' || dst_ip
    || '''] OR [network-traffic:src_port = ' || src_port || '] OR [network-traffic:dst_port = ' || dst_port || ']' END AS pattern,
  CASE WHEN is_anomaly THEN 'Detected by ' || alert_type || ' with severity ' || severity END AS description,
  CASE WHEN is_anomaly THEN 'Network Anomaly: ' || alert_type END AS name,
  CASE WHEN is_anomaly THEN 'network-anomaly,' || alert_type END AS labels,
  CASE WHEN is_anomaly THEN strftime(make_timestamp(ts_us // 1000000 * 1000000), '%Y-%m-%dT%H:%M:%S')
    || CASE WHEN ts_us % 1000000 <> 0 THEN '.' || lpad(CAST(ts_us % 1000000 AS VARCHAR), 6, '0') ELSE '' END || 'Z' END AS created
FROM alerts""",
)
def stix_indicators(spark, d):
    s = A.stix_indicator(F.col("ts_us"))
    df = alerts(spark, d).withColumn("s", s)
    return df.select(
        "event_id", "s.id", "s.pattern", "s.description", "s.name", F.array_join("s.labels", ",").alias("labels"), "s.created"
    )


# --- enrichment -----------------------------------------------------------------
def cidr_dim(spark, d):
    """Overlapping networks per nation: /16, /25 and /28 blocks of the hosts, /31 of the peers."""
    k = F.col("n_nationkey")
    network = (
        F.when(k == 0, "10.0.0.0/25")
        .when(k < 9, F.concat(F.lit("10.0.0."), (k - 1) * 16, F.lit("/28")))
        .when(k == 9, "192.168.0.0/31")
        .when(k == 10, "10.0.4.0/22")
        .otherwise(F.concat(F.lit("172."), k, F.lit(".0.0/16")))
    )
    return table(spark, d, "nation").select(
        network.alias("network"),
        (F.lit(64500) + k).cast("long").alias("asn"),
        F.col("n_name").alias("asn_description"),
        F.concat(F.lit("C"), F.col("n_regionkey")).alias("country"),
        F.lit("rir").alias("registry"),
        F.when(k % 2 == 0, F.concat(F.lit("city"), k)).alias("city"),
        F.when(k % 3 != 0, k.cast("double")).alias("latitude"),
        (-k).cast("double").alias("longitude"),
    )


_CIDR_SQL = """
cidr AS (
  SELECT *, CAST(split_part(network, '/', 2) AS INTEGER) AS plen, list_reduce([CAST(x AS BIGINT) FOR x IN split(split_part(network, '/', 1), '.')], lambda a, b: a * 256 + b) AS lo
  FROM (SELECT CASE WHEN n_nationkey = 0 THEN '10.0.0.0/25' WHEN n_nationkey < 9 THEN '10.0.0.' || ((n_nationkey - 1) * 16) || '/28'
      WHEN n_nationkey = 9 THEN '192.168.0.0/31' WHEN n_nationkey = 10 THEN '10.0.4.0/22' ELSE '172.' || n_nationkey || '.0.0/16' END AS network,
    CAST(64500 + n_nationkey AS BIGINT) AS asn, n_name AS asn_description, 'C' || n_regionkey AS country,
    CASE WHEN n_nationkey % 2 = 0 THEN 'city' || n_nationkey END AS city,
    CASE WHEN n_nationkey % 3 <> 0 THEN CAST(n_nationkey AS DOUBLE) END AS latitude, CAST(-n_nationkey AS DOUBLE) AS longitude FROM nation)
),
ips AS (
  SELECT ip, list_reduce([CAST(x AS BIGINT) FOR x IN split(ip, '.')], lambda a, b: a * 256 + b) AS num
  FROM (SELECT src_ip AS ip FROM alerts UNION SELECT dst_ip FROM alerts)
),
found AS (
  SELECT ip, arg_max(c, plen) AS c FROM ips JOIN cidr c ON num // CAST(pow(2, 32 - plen) AS BIGINT) = lo // CAST(pow(2, 32 - plen) AS BIGINT) GROUP BY ip
)"""


@query(
    "enrich_ips",
    f"""WITH {ALERTS_SQL}, {_CIDR_SQL}
SELECT event_id, s.c.network AS src_network, s.c.asn AS src_asn, s.c.country AS src_country, s.c.city AS src_city,
  CASE WHEN s.c.latitude IS NOT NULL AND s.c.longitude IS NOT NULL THEN s.c.latitude END AS src_lat,
  t.c.network AS dst_network, t.c.asn_description AS dst_org
FROM alerts LEFT JOIN found s ON src_ip = s.ip LEFT JOIN found t ON dst_ip = t.ip""",
)
def enrich_ips(spark, d):
    df = O.enrich_ips(alerts(spark, d), cidr_dim(spark, d))
    df = df.withColumns(
        {"sg": B.geo("src_ip_enrichment"), "sa": B.asn("src_ip_enrichment"), "da": B.asn("dst_ip_enrichment")}
    )
    return df.select(
        "event_id",
        F.col("src_ip_enrichment.network").alias("src_network"),
        F.col("sa.number").alias("src_asn"),
        F.col("sg.country_iso_code").alias("src_country"),
        F.col("sg.city_name").alias("src_city"),
        F.col("sg.location.lat").alias("src_lat"),
        F.col("dst_ip_enrichment.network").alias("dst_network"),
        F.col("da.organization").alias("dst_org"),
    )


# --- de-duplication ----------------------------------------------------------------
def _runs_sql(window_s: int) -> str:
    return f"""
gaps AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY dedup_key ORDER BY ts_us, event_id) AS gap FROM alerts),
firsts AS (SELECT *, gap IS NULL OR gap > {window_s * 1_000_000} AS is_first FROM gaps),
runs AS (SELECT *, max(CASE WHEN is_first THEN ts_us END) OVER (PARTITION BY dedup_key ORDER BY ts_us, event_id) AS run_us FROM firsts)"""


@query("dedup_alerts", f"WITH {ALERTS_SQL}, {_runs_sql(86_400)} SELECT event_id, dedup_key, ts_us FROM runs WHERE is_first")
def dedup_alerts(spark, d):
    return O.dedup_alerts(alerts(spark, d), 86_400, tie="event_id").select("event_id", "dedup_key", "ts_us")


@query(
    "dedup_merged",
    f"""WITH {ALERTS_SQL}, {_runs_sql(172_800)},
tagged AS (SELECT *, unnest(['c' || (event_id % 3), 'd' || (event_id % 2)]) AS cid, unnest([0, 1]) AS ci FROM runs),
ids AS (SELECT dedup_key, run_us, cid, min((ts_us, event_id, ci)) AS place FROM tagged GROUP BY ALL),
lists AS (SELECT dedup_key, run_us, string_agg(cid, ',' ORDER BY place) AS correlated FROM ids GROUP BY ALL),
merged AS (
  SELECT dedup_key, run_us, count(*) AS dedup_count, min(ts_us) AS first_seen_us, max(ts_us) AS last_seen_us,
    arg_min(event_id, (ts_us, event_id)) AS event_id, max({sql_q4('value_score')}) AS correlation_score, any_value(severity) AS severity,
    any_value(alert_type) AS alert_type, any_value(flow_key) AS flow_key
  FROM (SELECT *, inference_time_ms AS value_score FROM runs) GROUP BY dedup_key, run_us
)
SELECT merged.*, lists.correlated FROM merged JOIN lists ON merged.dedup_key = lists.dedup_key AND merged.run_us = lists.run_us""",
)
def dedup_merged(spark, d):
    df = alerts(spark, d).withColumns(
        {
            "correlated_alerts": F.array(
                F.concat(F.lit("c"), F.col("event_id") % 3), F.concat(F.lit("d"), F.col("event_id") % 2)
            ),
            "correlation_score": q4("inference_time_ms"),
        }
    )
    merged = O.dedup_alerts(df, 172_800, keep="merged", tie="event_id")
    return merged.select(
        "dedup_key", "run_us", "dedup_count", "first_seen_us", "last_seen_us", "event_id", "correlation_score",
        "severity", "alert_type", "flow_key", F.array_join("correlated_alerts", ",").alias("correlated"),
    )


@query(
    "suppress_seen",
    f"""WITH {ALERTS_SQL},
cut AS (SELECT min(ts_us) + (max(ts_us) - min(ts_us)) // 2 AS c FROM alerts),
seen AS (SELECT dedup_key, max(ts_us) AS last FROM alerts, cut WHERE ts_us < c GROUP BY dedup_key)
SELECT event_id, a.dedup_key FROM alerts a CROSS JOIN cut LEFT JOIN seen s ON a.dedup_key = s.dedup_key
WHERE a.ts_us >= c AND (last IS NULL OR a.ts_us - last > 172800000000)""",
)
def suppress_seen(spark, d):
    df = alerts(spark, d)
    cut = df.agg((F.min("ts_us") + F.floor((F.max("ts_us") - F.min("ts_us")) / 2)).alias("c")).scalar()
    seen = df.filter(F.col("ts_us") < cut).select("dedup_key", F.col("ts_us").alias("last_seen_us"))
    return O.suppress_seen(df.filter(F.col("ts_us") >= cut), seen, 172_800).select("event_id", "dedup_key")


# --- correlation -----------------------------------------------------------------
def _group_sql(idle_s: int) -> str:
    return f"""
ggaps AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY group_id ORDER BY ts_us, event_id) AS ggap FROM members),
sessions AS (
  SELECT *, max(CASE WHEN ggap IS NULL OR ggap > {idle_s * 1_000_000} THEN ts_us END) OVER (PARTITION BY group_id ORDER BY ts_us, event_id) AS session_us
  FROM ggaps
)"""


def _scores_sql(idle_s: int) -> str:
    """Every pair of a session, spelled out: the brute-force form of the linear operator."""
    return f"""{_group_sql(idle_s)},
ranked AS (SELECT *, row_number() OVER (PARTITION BY group_id, session_us ORDER BY ts_us, event_id) - 1 AS k FROM sessions),
pairs AS (
  SELECT n.event_id, n.k - o.k AS w,
    CASE WHEN n.flow_key <> '' THEN 0.5e0 ELSE 0e0 END
      + CASE WHEN n.src_ip <> '' AND n.dst_ip <> '' THEN 0.3e0 ELSE 0e0 END
      + CASE WHEN n.dst_port <> 0 AND n.dst_port = o.dst_port THEN 0.1e0 ELSE 0e0 END
      + CASE WHEN n.protocol <> 0 AND n.protocol = o.protocol THEN 0.05e0 ELSE 0e0 END
      + CASE WHEN n.ts_us - o.ts_us < 3600000000 THEN 0.1e0 * (1 - (n.ts_us - o.ts_us) / 3600e6) ELSE 0e0 END AS points,
    CASE WHEN n.flow_key <> '' THEN 1 ELSE 0 END + CASE WHEN n.src_ip <> '' AND n.dst_ip <> '' THEN 1 ELSE 0 END
      + CASE WHEN n.dst_port <> 0 AND n.dst_port = o.dst_port THEN 1 ELSE 0 END
      + CASE WHEN n.protocol <> 0 AND n.protocol = o.protocol THEN 1 ELSE 0 END
      + CASE WHEN n.ts_us - o.ts_us < 3600000000 THEN 1 ELSE 0 END AS factors
  FROM ranked n JOIN ranked o ON n.group_id = o.group_id AND n.session_us = o.session_us AND o.k < n.k
),
scored AS (SELECT event_id, sum(w * points / greatest(factors, 1)) / sum(w) AS s FROM pairs GROUP BY event_id)"""


@query(
    "correlation_sessions",
    f"""WITH {ALERTS_SQL}, members AS (SELECT * FROM alerts), {_group_sql(3600)}
SELECT event_id, group_id, session_us FROM sessions""",
)
def correlation_sessions(spark, d):
    return O.correlation_sessions(alerts(spark, d), 3600, tie="event_id").select("event_id", "group_id", "session_us")


@query(
    "group_scores",
    f"""WITH {ALERTS_SQL}, members AS (SELECT * REPLACE (substr(sha256('flows=' || flow_key || '|ips=' || src_ip || '->' || dst_ip), 1, 16) AS group_id)
  FROM (SELECT * REPLACE ('f' || (event_id % 40) AS flow_key, 'a' AS src_ip, 'b' AS dst_ip) FROM alerts)), {_scores_sql(86_400)}
SELECT r.event_id, r.group_id, r.session_us, r.k AS group_rank, {sql_q4('coalesce(s, 0)')} AS correlation_score
FROM ranked r LEFT JOIN scored ON r.event_id = scored.event_id""",
)
def group_scores(spark, d):
    """Coarse flows, so that sessions are long and hold both near and far members."""
    df = alerts(spark, d).withColumns(
        {
            "flow_key": F.concat(F.lit("f"), F.col("event_id") % 40),
            "src_ip": F.lit("a"),
            "dst_ip": F.lit("b"),
        }
    )
    # counted by group, and then scored
    out = O.group_scores(stored(df, "alerts"), 86_400, tie="event_id")
    return out.select(
        "event_id", "group_id", "session_us", F.col("group_rank").cast("long").alias("group_rank"),
        q4("correlation_score").alias("correlation_score"),
    )


_LINKS = ("flow_key", "src_ip, dst_ip", "src_ip", "dst_ip")


@query(
    "correlation_links",
    f"""WITH {ALERTS_SQL},
prevs AS (SELECT *, {', '.join(f'lag(event_id) OVER (PARTITION BY {k} ORDER BY ts_us, event_id) AS p{i}' for i, k in enumerate(_LINKS))} FROM alerts),
cand AS ({' UNION '.join(f'SELECT event_id, p{i} AS other FROM prevs WHERE p{i} IS NOT NULL' for i in range(4))}),
j AS (
  SELECT a.event_id AS alert, b.event_id AS linked_to, a.ts_us - b.ts_us AS gap,
    CASE WHEN a.flow_key = b.flow_key THEN 1 ELSE 0 END AS f, CASE WHEN a.src_ip = b.src_ip THEN 1 ELSE 0 END AS s,
    CASE WHEN a.dst_ip = b.dst_ip THEN 1 ELSE 0 END AS t, CASE WHEN a.dst_port = b.dst_port THEN 1 ELSE 0 END AS p,
    CASE WHEN a.protocol = b.protocol THEN 1 ELSE 0 END AS q
  FROM cand JOIN alerts a ON cand.event_id = a.event_id JOIN alerts b ON cand.other = b.event_id
)
SELECT alert, linked_to, gap / CAST(1e6 AS DOUBLE) AS gap_s,
  {sql_q4('(0.5e0 * f + CASE WHEN s + t = 2 THEN 0.3e0 WHEN s + t = 1 THEN 0.15e0 ELSE 0 END + 0.1e0 * p + 0.05e0 * q + CASE WHEN gap < 3600000000 THEN 0.1e0 * (1 - gap / 3600e6) ELSE 0 END) / greatest(f + least(s + t, 1) + p + q + CASE WHEN gap < 3600000000 THEN 1 ELSE 0 END, 1)')} AS score
FROM j WHERE gap <= 3600000000""",
)
def correlation_links(spark, d):
    out = O.correlation_links(alerts(spark, d), 3600, tie="event_id")
    return out.select("alert", "linked_to", "gap_s", q4("score").alias("score"))


@query(
    "correlation_id",
    f"""WITH {ALERTS_SQL},
f AS (SELECT src_ip AS source, string_agg(x, ',' ORDER BY x) AS flows FROM (SELECT DISTINCT src_ip, flow_key AS x FROM alerts) GROUP BY src_ip),
p AS (SELECT src_ip AS source, string_agg(src_ip || '->' || x, ',' ORDER BY x) AS pairs FROM (SELECT DISTINCT src_ip, dst_ip AS x FROM alerts) GROUP BY src_ip)
SELECT f.source, substr(sha256('flows=' || flows || '|ips=' || pairs), 1, 16) AS group_id FROM f JOIN p ON f.source = p.source""",
)
def correlation_id(spark, d):
    return O.correlation_id(alerts(spark, d).withColumn("source", F.col("src_ip")), ["source"])


# --- documents, rows, messages --------------------------------------------------------
_ISO = """strftime(make_timestamp(ts_us // 1000000 * 1000000), '%Y-%m-%dT%H:%M:%S')
    || CASE WHEN ts_us % 1000000 <> 0 THEN '.' || lpad(CAST(ts_us % 1000000 AS VARCHAR), 6, '0') ELSE '' END"""
_TITLE = """CASE alert_type WHEN 'deep_path_lstm_ae' THEN 'Deep Path Lstm Ae' WHEN 'xgboost_supervised' THEN 'Xgboost Supervised'
    WHEN 'unknown' THEN 'Unknown' ELSE 'Fast Path' END"""


@query(
    "ecs_events",
    f"""WITH {ALERTS_SQL}
SELECT alert_id, {_ISO} || 'Z' AS "timestamp", 'alert' AS kind, 'network,intrusion_detection' AS category,
  CASE WHEN is_anomaly THEN 'success' ELSE 'failure' END AS outcome, severity, {_RISK} AS risk_score, src_ip AS source_ip, dst_port AS destination_port,
  CASE protocol WHEN 6 THEN 'tcp' ELSE 'udp' END AS protocol, CASE protocol WHEN 6 THEN 'tcp' ELSE 'udp' END AS transport,
  'outbound' AS direction, alert_type AS rule_id, {_TITLE} AS rule_name, src_ip || ',' || dst_ip AS indicator,
  coalesce(model_version, 'unknown') AS observer_version, {_SCORE} AS score, dedup_key AS group_id
FROM alerts""",
)
def ecs_events(spark, d):
    e = B.ecs_event(alerts(spark, d))
    return e.select(
        "alert_id", "timestamp", "event.kind", F.array_join("event.category", ",").alias("category"), "event.outcome",
        "event.severity", "event.risk_score", F.col("source.ip").alias("source_ip"),
        F.col("destination.port").alias("destination_port"), "network.protocol", "network.transport", "network.direction",
        F.col("rule.id").alias("rule_id"), F.col("rule.name").alias("rule_name"),
        F.array_join("threat.indicator.ip", ",").alias("indicator"), F.col("observer.version").alias("observer_version"),
        "alert.score", "correlation.group_id",
    )


@query(
    "board_rows",
    f"""WITH {ALERTS_SQL}
SELECT alert_id, alert_type, flow_key, "timestamp", {_ISO} AS timestamp_iso, is_anomaly, severity, status, src_ip, dst_ip, src_port,
  dst_port, protocol, anomaly_score, reconstruction_error, anomaly_probability, model_version, inference_time_ms FROM alerts""",
)
def board_rows(spark, d):
    return B.board_rows(alerts(spark, d))


_COLOR = "CASE severity WHEN 'critical' THEN '#FF0000' WHEN 'error' THEN '#FF4500' ELSE '#FFA500' END"
_MSG = """'@Flow:@ `' || flow_key || '`' || chr(10) || '@Severity:@ ' || severity || chr(10) || '@Source:@ ' || src_ip || ':' || src_port
    || chr(10) || '@Destination:@ ' || dst_ip || ':' || dst_port || chr(10)"""


@query(
    "notifications",
    f"""WITH {ALERTS_SQL}, kept AS (SELECT * FROM alerts WHERE severity IN ('error', 'critical'))
SELECT alert_id, channel, CASE channel WHEN 'pagerduty' THEN severity ELSE {_COLOR} END AS mark,
  CASE channel WHEN 'pagerduty' THEN 'Network Anomaly: ' || alert_type || ' - ' || flow_key
    ELSE replace({_MSG}, '@', CASE channel WHEN 'slack' THEN '*' ELSE '**' END) END AS body,
  CASE channel WHEN 'pagerduty' THEN NULL ELSE CAST(floor("timestamp") AS BIGINT) END AS sent
FROM kept CROSS JOIN (VALUES ('slack'), ('pagerduty'), ('mattermost')) c(channel)""",
)
def notifications(spark, d):
    """Messages of error and worse for three channels, read back from their JSON."""
    urgent = B.min_severity(alerts(spark, d), "error")
    out = None
    for channel in ("slack", "pagerduty", "mattermost"):
        one = B.fan_out_channels(urgent, ["slack", "pagerduty", "mattermost"], [channel])
        rows = B.notification_rows(one, channel)
        out = rows if out is None else out.unionByName(rows)
    get = lambda path: F.get_json_object("payload", path)
    chat = F.col("channel") != "pagerduty"
    text = get("$.attachments[0].text")
    upto_score = F.substring_index(F.substring_index(text, "*Score", 1), "**Score", 1)
    return out.select(
        "alert_id",
        "channel",
        F.when(chat, get("$.attachments[0].color")).otherwise(get("$.payload.severity")).alias("mark"),
        F.when(chat, F.regexp_replace(upto_score, r"\*$", "")).otherwise(get("$.payload.summary")).alias("body"),
        F.when(chat, get("$.attachments[0].ts").cast("long")).alias("sent"),
    )


# --- the whole chain ------------------------------------------------------------------
@query(
    "alert_chain",
    f"""WITH {ALERTS_SQL}, {_CIDR_SQL}, {_runs_sql(86_400)},
members AS (SELECT * FROM runs WHERE is_first), {_scores_sql(259_200)}
SELECT r.alert_id, r.event_id, r.severity, r.output_topic, r.dedup_key, r.group_id, c1.c.asn AS src_asn, c2.c.asn AS dst_asn,
  r.is_anomaly AS has_indicator, {sql_q4('coalesce(s, 0)')} AS correlation_score
FROM ranked r LEFT JOIN scored ON r.event_id = scored.event_id LEFT JOIN found c1 ON r.src_ip = c1.ip LEFT JOIN found c2 ON r.dst_ip = c2.ip""",
)
def whole_chain(spark, d):
    out = alert_chain(V.detections(spark, d), cidr_dim(spark, d), window_s=86_400, idle_s=259_200, tie="event_id")
    return out.select(
        "alert_id", "event_id", "severity", "output_topic", "dedup_key", "group_id",
        F.col("src_ip_enrichment.asn").alias("src_asn"), F.col("dst_ip_enrichment.asn").alias("dst_asn"),
        F.col("stix_indicator").isNotNull().alias("has_indicator"), q4("correlation_score").alias("correlation_score"),
    )


@query(
    "routed_counts",
    f"WITH {ALERTS_SQL} SELECT output_topic AS topic, count(*) AS n FROM alerts GROUP BY output_topic",
)
def routed_counts(spark, d):
    return alerts(spark, d).groupBy(S.route("severity").alias("topic")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "iso_times",
    f"SELECT event_id, {_ISO.replace('ts_us', 'epoch_us(ts)')} AS iso FROM events",
)
def iso_times(spark, d):
    return table(spark, d, "events").select("event_id", iso(F.unix_micros(F.col("ts").cast("timestamp"))).alias("iso"))
