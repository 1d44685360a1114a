"""Registered queries over alerts: pages, boards, statistics, rates, quantiles, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.operators import board as B
from flowspark.operators import monitor as M
from flowspark.operators import ordinal as N
from flowspark.plans import views as V
from flowspark.plans.catalog import q4, query, sql_q4, table
from flowspark.plans.q_alerts import _SCORE, ALERTS_SQL, alerts

_T0 = 1704067200.0  # first midnight of the event table


@query(
    "filter_alerts",
    f"""WITH {ALERTS_SQL}
SELECT event_id, alert_id FROM alerts WHERE alert_type = 'fast_path' AND severity = 'warning' AND is_anomaly
  AND contains(flow_key, '192.168.0.1:') AND "timestamp" >= {_T0 + 86400} AND "timestamp" <= {_T0 + 20 * 86400}""",
)
def filter_alerts(spark, d):
    return B.filter_alerts(
        alerts(spark, d), alert_type="fast_path", severity="WARNING", is_anomaly=True, src_ip="", flow_key="192.168.0.1:",
        start=_T0 + 86400, end=_T0 + 20 * 86400,
    ).select("event_id", "alert_id")


@query(
    "filter_board",
    f"""WITH {ALERTS_SQL}
SELECT event_id, severity FROM alerts WHERE severity IN ('critical', 'error', 'warning')
  AND (contains(alert_type, 'fast_path') OR contains(alert_type, 'deep_path') OR contains(alert_type, 'xgboost_supervised'))
  AND is_anomaly AND "timestamp" >= {_T0 + 10 * 86400} - 168 * 3600""",
)
def filter_board(spark, d):
    return B.filter_board(alerts(spark, d), hours=168, now=_T0 + 10 * 86400).select("event_id", "severity")


@query(
    "get_alert",
    f"""WITH {ALERTS_SQL}
SELECT event_id, alert_id, severity FROM alerts WHERE alert_id = (SELECT alert_id FROM alerts ORDER BY event_id DESC LIMIT 1)""",
)
def get_alert(spark, d):
    df = alerts(spark, d)
    wanted = df.agg(F.max_by("alert_id", "event_id").alias("id")).scalar()
    return B.get_alert(df, wanted).select("event_id", "alert_id", "severity")


@query(
    "page_alerts",
    f"""WITH {ALERTS_SQL}, hits AS (SELECT * FROM alerts WHERE severity = 'error')
SELECT event_id, "timestamp", (SELECT count(*) FROM hits) AS total FROM hits ORDER BY "timestamp" DESC, event_id LIMIT 100 OFFSET 50""",
)
def page_alerts(spark, d):
    hits = B.filter_alerts(alerts(spark, d), severity="error")
    return B.page_alerts(hits, offset=50, tie="event_id").select("event_id", "timestamp", "total")


@query(
    "latest_board",
    f"""WITH {ALERTS_SQL}, newest AS (SELECT * FROM alerts ORDER BY ts_us DESC, event_id LIMIT 1000)
SELECT strftime(make_timestamp(ts_us), '%H:%M:%S') AS "time", alert_type AS "type", severity,
  CASE WHEN length(flow_key) > 30 THEN substr(flow_key, 1, 30) || '...' ELSE flow_key END AS flow,
  src_ip || ':' || src_port AS source, dst_ip || ':' || dst_port AS destination,
  coalesce(format('{{:.3f}}', {_SCORE}), 'N/A') AS score, coalesce(model_version, 'N/A') AS model, is_anomaly AS anomaly
FROM newest""",
)
def latest_board(spark, d):
    return B.latest_board(alerts(spark, d), tie="event_id")


@query(
    "top_terms",
    f"WITH {ALERTS_SQL} SELECT src_ip AS term, count(*) AS n FROM alerts GROUP BY src_ip ORDER BY n DESC, term LIMIT 10",
)
def top_terms(spark, d):
    return B.top_terms(alerts(spark, d), "src_ip")


@query(
    "alert_stats",
    f"""WITH {ALERTS_SQL}, hit AS (SELECT *, CASE WHEN is_anomaly THEN 'success' ELSE 'failure' END AS outcome FROM alerts WHERE "timestamp" >= {_T0 + 86400}),
u AS (SELECT 'total' AS dimension, 'all' AS term, count(*) AS n FROM hit
  UNION ALL SELECT 'severity', severity, count(*) FROM hit GROUP BY severity
  UNION ALL SELECT 'type', alert_type, count(*) FROM hit GROUP BY alert_type
  UNION ALL SELECT 'outcome', outcome, count(*) FROM hit GROUP BY outcome)
SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY n DESC, term) <= 3""",
)
def alert_stats(spark, d):
    return B.alert_stats(alerts(spark, d), start=_T0 + 86400, top=3)


@query(
    "alert_counters",
    f"WITH {ALERTS_SQL} SELECT severity, count(*) AS total, count(*) FILTER (WHERE is_anomaly) AS anomalies FROM alerts GROUP BY ROLLUP (severity)",
)
def alert_counters(spark, d):
    return B.alert_counters(alerts(spark, d))


@query(
    "retention_tiers",
    f"""WITH {ALERTS_SQL}, aged AS (SELECT ({_T0 + 95 * 86400} - "timestamp" * 1) / 86400 AS age FROM alerts UNION ALL SELECT ({_T0 + 33 * 86400} - "timestamp") / 86400 FROM alerts)
SELECT CASE WHEN age >= 90 THEN 'delete' WHEN age >= 30 THEN 'cold' WHEN age >= 7 THEN 'warm' ELSE 'hot' END AS tier, count(*) AS n FROM aged GROUP BY 1""",
)
def retention_tiers(spark, d):
    df = alerts(spark, d)
    both = B.retention_tier(df, "2024-04-05 00:00:00").unionByName(B.retention_tier(df, "2024-02-03 00:00:00"))
    return both.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


# --- monitoring ------------------------------------------------------------------------
def _timed(spark, d):
    return V.detections(spark, d).withColumn("ts", F.timestamp_micros("ts_us"))


@query(
    "windowed_rate",
    f"""WITH {ALERTS_SQL} SELECT alert_type, ts_us // 300000000 * 300 AS window_start, count(*) AS n, count(*) / CAST(300 AS DOUBLE) AS rate
FROM alerts GROUP BY ALL""",
)
def windowed_rate(spark, d):
    rates = M.windowed_rate(_timed(spark, d), ["alert_type"])
    return rates.withColumn("window_start", F.unix_seconds("window_start"))


@query(
    "sliding_rate",
    f"""WITH {ALERTS_SQL}, w AS (SELECT unnest([0, 1, 2, 3, 4]) * 60 AS back, ts_us // 60000000 * 60 AS slot FROM alerts)
SELECT slot - back AS window_start, count(*) AS n, count(*) / CAST(300 AS DOUBLE) AS rate FROM w GROUP BY ALL""",
)
def sliding_rate(spark, d):
    rates = M.windowed_rate(_timed(spark, d), slide="1 minute")
    return rates.withColumn("window_start", F.unix_seconds("window_start"))


@query(
    "windowed_quantiles",
    f"""WITH {ALERTS_SQL} SELECT ts_us // 3600000000 * 3600 AS window_start, {', '.join(f"{sql_q4(f'quantile_cont(inference_time_ms, {p})')} AS p{round(p * 100)}" for p in (0.5, 0.95, 0.99))}
FROM alerts GROUP BY 1""",
)
def windowed_quantiles(spark, d):
    out = M.windowed_quantiles(_timed(spark, d), "inference_time_ms", window="1 hour", exact=True)
    return out.select(F.unix_seconds("window_start").alias("window_start"), *[q4(p).alias(p) for p in ("p50", "p95", "p99")])


@query("windowed_quantiles_approx")
def windowed_quantiles_approx(spark, d):
    return M.windowed_quantiles(_timed(spark, d), "inference_time_ms", window="1 hour")


@query(
    "quantile_sketches",
    f"""WITH {ALERTS_SQL} SELECT ts_us // 3600000000 * 3600 AS window_start, count(inference_time_ms) AS n, true AS p50, true AS p95, true AS p99
FROM alerts GROUP BY 1 HAVING count(inference_time_ms) > 0""",
)
def quantile_sketches(spark, d):
    """Hours merged from five-minute sketches, these from minutes; whether each quantile's exact rank is within twice the stated error."""
    df, value = _timed(spark, d), "inference_time_ms"
    minutes = M.quantile_sketches(df, value)
    hours = M.sketch_quantiles(M.merge_sketches(M.merge_sketches(minutes), "1 hour"))
    rows = df.select(F.window("ts", "1 hour")["start"].alias("window_start"), F.col(value).alias("v")).filter("v is not null")
    names = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    sums = [F.count(F.when(test, 1)).alias(f"{p}_{s}") for p in names for s, test in (("lt", F.col("v") < F.col(p)), ("le", F.col("v") <= F.col(p)))]
    counted = rows.join(hours, "window_start").groupBy("window_start", "n").agg(*sums)
    off = 2 * M.SKETCH_ERROR
    near = [((F.col(f"{p}_lt") <= (at + off) * F.col("n")) & (F.col(f"{p}_le") >= (at - off) * F.col("n"))).alias(p) for p, at in names.items()]
    return counted.select(F.unix_seconds("window_start").alias("window_start"), "n", *near)


@query(
    "top_sources",
    f"""WITH {ALERTS_SQL}, c AS (SELECT src_ip, ts_us // 86400000000 * 86400 AS window_start, count(*) AS n FROM alerts GROUP BY ALL)
SELECT *, n / CAST(86400 AS DOUBLE) AS rate, row_number() OVER (PARTITION BY window_start ORDER BY n DESC, src_ip) AS rank FROM c QUALIFY rank <= 10""",
)
def top_sources(spark, d):
    out = M.top_sources(_timed(spark, d), window="1 day")
    return out.withColumn("window_start", F.unix_seconds("window_start"))


@query(
    "stage_counters",
    f"""WITH {ALERTS_SQL} SELECT 'received' AS stage, count(*) AS n FROM alerts UNION ALL SELECT 'anomalies', count(*) FROM alerts WHERE is_anomaly
UNION ALL SELECT 'sent', count(*) FROM alerts WHERE severity IN ('error', 'critical')""",
)
def stage_counters(spark, d):
    df = alerts(spark, d)
    return M.stage_counters(received=df, anomalies=df.filter("is_anomaly"), sent=B.min_severity(df, "error"))


@query(
    "evaluate_scores",
    f"""WITH s AS (SELECT floor(value) AS s, CASE WHEN event_type = 'error' OR value > 120 THEN 1 ELSE 0 END AS y FROM events),
g AS (SELECT s, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY s),
c AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g),
r AS (SELECT sum(pos * (n - fp + neg / 2)) / any_value(p * n) AS auc, sum(CASE WHEN s > 100 THEN pos ELSE 0 END) AS tp, sum(CASE WHEN s > 100 THEN neg ELSE 0 END) AS fp,
  min(CASE WHEN tp / p >= 0.95 THEN fp / n END) AS fpr, sum(pos) AS p FROM c)
SELECT {sql_q4('auc')} AS auc, {sql_q4('tp / (tp + fp)')} AS "precision", {sql_q4('tp / p')} AS recall,
  {sql_q4('2 * (tp / (tp + fp)) * (tp / p) / (tp / (tp + fp) + tp / p)')} AS f1, {sql_q4('fpr')} AS fpr_at_tpr FROM r""",
)
def evaluate_scores(spark, d):
    y = F.when((F.col("event_type") == "error") | (F.col("value") > 120), 1).otherwise(0)
    df = table(spark, d, "events").select(F.floor("value").cast("double").alias("s"), y.alias("y"))
    out = M.evaluate(df, "s", "y", 100)
    return out.select(*[q4(c).alias(c) for c in out.columns])


_PSI = ("l_quantity", "l_extendedprice", "l_discount")


def _moved(c: str) -> str:
    """The open lines' quantities are moved up, so that one feature drifts."""
    return "l_quantity + 12" if c == "l_quantity" else c


def _psi_sql(c: str) -> str:
    return f"""
SELECT '{c}' AS feature, sum((cc - rr) * ln(cc / rr)) AS psi FROM (
  SELECT greatest(coalesce(r.n / CAST(r.t AS DOUBLE), 0), 1e-6) AS rr, greatest(coalesce(q.n / CAST(q.t AS DOUBLE), 0), 1e-6) AS cc FROM
  (SELECT bin, count(*) AS n, sum(count(*)) OVER () AS t FROM (SELECT len(list_filter(e, lambda x: x <= v)) AS bin FROM (SELECT {c} AS v FROM lineitem WHERE l_linestatus = 'F'), edges_{c}) GROUP BY bin) r
  FULL JOIN (SELECT bin, count(*) AS n, sum(count(*)) OVER () AS t FROM (SELECT len(list_filter(e, lambda x: x <= v)) AS bin FROM (SELECT {_moved(c)} AS v FROM lineitem WHERE l_linestatus = 'O'), edges_{c}) GROUP BY bin) q
  ON r.bin = q.bin)"""


@query(
    "psi_drift",
    "WITH "
    + ", ".join(
        f"""o_{c} AS (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS i, count(*) OVER () AS n FROM lineitem WHERE l_linestatus = 'F'),
edges_{c} AS (SELECT list(DISTINCT v) AS e FROM o_{c} WHERE list_contains([least(n * k // 10, n - 1) FOR k IN range(1, 10)], i))"""
        for c in _PSI
    )
    + ", u AS ("
    + " UNION ALL ".join(_psi_sql(c) for c in _PSI)
    + f") SELECT feature, {sql_q4('psi')} AS psi, psi > 0.25 AS drifted FROM u",
)
def psi_drift(spark, d):
    line = table(spark, d, "lineitem")
    ref = line.filter("l_linestatus = 'F'")
    cur = line.filter("l_linestatus = 'O'").withColumn("l_quantity", F.expr(_moved("l_quantity")))
    out = M.psi_drift(ref, cur, _PSI)
    return out.withColumn("psi", q4("psi"))


@query(
    "auc_decay",
    """WITH m AS (SELECT date_part('month', o_orderdate) AS month, avg(CASE WHEN o_orderstatus = 'F' THEN 0.9e0 ELSE 0.8e0 END) AS auc FROM orders GROUP BY 1),
l AS (SELECT *, (lag(auc) OVER (ORDER BY month) - auc) / lag(auc) OVER (ORDER BY month) AS decay FROM m)
SELECT CAST(month AS INTEGER) AS month, """
    + sql_q4("auc")
    + " AS auc, "
    + sql_q4("decay")
    + " AS decay, auc < 0.85 OR coalesce(decay > 0.05, false) AS retrain FROM l",
)
def auc_decay(spark, d):
    monthly = table(spark, d, "orders").groupBy(F.month("o_orderdate").alias("month")).agg(
        F.avg(F.when(F.col("o_orderstatus") == "F", 0.9).otherwise(0.8)).alias("auc")
    )
    out = M.auc_decay(monthly)
    return out.select("month", q4("auc").alias("auc"), q4("decay").alias("decay"), "retrain")


# --- ordinals ----------------------------------------------------------------------------
@query(
    "percentile_threshold",
    """WITH o AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem)
SELECT v AS threshold FROM o WHERE i = least(n * 95 // 100, n - 1)""",
)
def percentile_threshold(spark, d):
    return N.percentile_threshold(table(spark, d, "lineitem"), "l_extendedprice", 95.0)


@query(
    "split_ordered",
    f"""WITH {V.DETECTIONS_SQL}, o AS (SELECT event_id, row_number() OVER (ORDER BY flow_key, ts_us, event_id) - 1 AS i, count(*) OVER () AS n FROM detections)
SELECT event_id, CASE WHEN i / (n - 1) < 0.8e0 THEN 'train' WHEN i / (n - 1) < 0.8e0 + 0.1e0 THEN 'val' ELSE 'test' END AS split FROM o""",
)
def split_ordered(spark, d):
    return N.split_ordered(V.detections(spark, d), ts="ts_us", ties=["event_id"]).select("event_id", "split")


@query(
    "split_stratified",
    f"""WITH {V.DETECTIONS_SQL}, o AS (SELECT event_id, alert_type, row_number() OVER (PARTITION BY alert_type ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) - 1 AS i,
  count(*) OVER (PARTITION BY alert_type) AS n FROM detections)
SELECT event_id, CASE WHEN i / n < 0.7e0 THEN 'train' WHEN i / n < 0.7e0 + 0.15e0 THEN 'val' ELSE 'test' END AS split FROM o""",
)
def split_stratified(spark, d):
    return N.split_stratified(V.detections(spark, d), "alert_type", "event_id").select("event_id", "split")
