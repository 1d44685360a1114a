"""Alert documents, dashboard rows, notification rows and the queries over alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowspark.functions import alerts as A
from flowspark.functions import scores as S
from flowspark.functions.keys import col, protocol_name
from flowspark.functions.times import iso
from flowspark.operators.alerts import with_micros
from flowspark.schemas import SEVERITIES

# fixed values: constants of the published document and message formats
MODULE = "network_anomaly_detection"
SENSOR = "network-anomaly-detector"
COLORS = {
    "critical": "#FF0000",
    "error": "#FF4500",
    "warning": "#FFA500",
    "info": "#00BFFF",
    "debug": "#808080",
}
PAGE_SEVERITY = {"critical": "critical", "error": "error", "warning": "warning", "info": "info"}
BOARD_HOURS = (1, 6, 24, 168)
BOARD_SEVERITIES = ("critical", "error", "warning")
BOARD_TYPES = ("fast_path", "deep_path", "xgboost_supervised")
TIERS = ((90, "delete"), (30, "cold"), (7, "warm"))


def _field(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


# --- F4, F5, F6 ------------------------------------------------------------------
def geo(c: str | Column) -> Column:
    """Country, city and (when both coordinates exist) location of an enrichment; null on null."""
    e = col(c)
    placed = e["latitude"].isNotNull() & e["longitude"].isNotNull()
    location = F.struct(e["latitude"].alias("lat"), e["longitude"].alias("lon"))
    return F.when(
        e.isNotNull(),
        F.struct(
            e["country"].alias("country_iso_code"),
            e["city"].alias("city_name"),
            F.when(placed, location).alias("location"),
        ),
    )


def asn(c: str | Column) -> Column:
    e = col(c)
    return F.when(
        e.isNotNull(), F.struct(e["asn"].alias("number"), e["asn_description"].alias("organization"))
    )


def title_case(c: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the others."""
    return F.array_join(F.transform(F.split(c, r"(?<=[^\p{L}])"), F.initcap), "")


def ecs_event(alerts: DataFrame) -> DataFrame:
    """One nested event document per alert: twelve objects beside the timestamp."""
    df = with_micros(alerts)
    src, dst = "src_ip_enrichment", "dst_ip_enrichment"
    known = src in df.columns
    kind = F.col("alert_type")

    def end(side: str) -> Column:
        e = f"{side}_ip_enrichment"
        extra = [geo(e).alias("geo"), asn(e).alias("as")] if known else []
        return F.struct(F.col(f"{side}_ip").alias("ip"), F.col(f"{side}_port").alias("port"), *extra)

    severity = F.coalesce(_field(df, "severity"), F.lit("warning"))
    return df.select(
        "alert_id",
        iso(F.col("ts_us"), "Z").alias("timestamp"),
        F.struct(
            F.lit("alert").alias("kind"),
            F.array(F.lit("network"), F.lit("intrusion_detection")).alias("category"),
            F.array(F.lit("info"), F.lit("anomaly")).alias("type"),
            F.lit("alerted").alias("action"),
            F.when(F.col("is_anomaly"), "success").otherwise("failure").alias("outcome"),
            severity.alias("severity"),
            S.risk_score(_field(df, "severity")).alias("risk_score"),
            F.lit(MODULE).alias("module"),
            F.lit(f"{MODULE}.alert").alias("dataset"),
        ).alias("event"),
        end("src").alias("source"),
        end("dst").alias("destination"),
        F.struct(
            protocol_name("protocol", "ecs").alias("protocol"),
            F.when(F.col("protocol") == 6, "tcp").otherwise("udp").alias("transport"),
            F.lit("outbound").alias("direction"),
        ).alias("network"),
        F.struct(F.lit(SENSOR).alias("name")).alias("host"),
        F.struct(
            kind.alias("id"),
            title_case(F.replace(kind, F.lit("_"), F.lit(" "))).alias("name"),
            F.concat(F.lit("Network anomaly detected by "), kind).alias("description"),
            F.lit(MODULE).alias("ruleset"),
        ).alias("rule"),
        F.struct(
            F.struct(F.array("src_ip", "dst_ip").alias("ip")).alias("indicator"),
            *([F.coalesce(src, dst).alias("enrichment")] if known else []),
        ).alias("threat"),
        F.struct(
            F.lit(SENSOR).alias("name"),
            F.lit("network_sensor").alias("type"),
            F.lit("custom").alias("vendor"),
            F.coalesce("model_version", F.lit("unknown")).alias("version"),
        ).alias("observer"),
        F.struct(
            kind.alias("type"),
            S.alert_score().alias("score"),
            F.col("model_version"),
            F.col("inference_time_ms"),
        ).alias("alert"),
        F.struct(
            *([F.col(src).alias("src_ip"), F.col(dst).alias("dst_ip")] if known else []),
            _field(df, "stix_indicators").alias("stix"),
        ).alias("enrichment"),
        F.struct(
            _field(df, "correlated_alerts", "array<string>").alias("correlated_alerts"),
            _field(df, "correlation_score", "double").alias("correlation_score"),
            _field(df, "dedup_key").alias("group_id"),
        ).alias("correlation"),
    )


def board_rows(alerts: DataFrame) -> DataFrame:
    """Flat dashboard rows with defaults for what is missing."""
    df = with_micros(alerts)
    keep = [
        "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "anomaly_score", "reconstruction_error",
        "anomaly_probability", "model_version", "inference_time_ms", "src_ip_enrichment",
        "dst_ip_enrichment", "stix_indicators", "correlated_alerts", "correlation_score",
    ]
    return df.select(
        A.alert_id().alias("alert_id"),
        F.coalesce("alert_type", F.lit("unknown")).alias("alert_type"),
        F.coalesce("flow_key", F.lit("")).alias("flow_key"),
        F.coalesce("timestamp", F.lit(0.0)).alias("timestamp"),
        iso(F.coalesce("ts_us", F.lit(0).cast("long"))).alias("timestamp_iso"),
        F.coalesce("is_anomaly", F.lit(False)).alias("is_anomaly"),
        F.coalesce(_field(df, "severity"), F.lit("warning")).alias("severity"),
        F.coalesce(_field(df, "status"), F.lit("new")).alias("status"),
        *[c for c in keep if c in df.columns],
    )


# --- F7, P22, P26 -----------------------------------------------------------------
def min_severity(alerts: DataFrame, level: str = "warning") -> DataFrame:
    """Alerts at or above a severity; unknown severities rank as warning."""
    floor = SEVERITIES.index(level.lower()) if level.lower() in SEVERITIES else 3
    return alerts.filter(S.severity_rank(F.coalesce("severity", F.lit("warning"))) >= floor)


def fan_out_channels(alerts: DataFrame, enabled: Sequence[str], configured: Sequence[str]) -> DataFrame:
    """One row per alert and channel that is both enabled and configured."""
    usable = [c for c in ("slack", "pagerduty", "mattermost", "webhook") if c in {e.strip() for e in enabled} and c in configured]
    if not usable:
        return alerts.withColumn("channel", F.lit(None).cast("string")).filter(F.lit(False))
    return alerts.withColumn("channel", F.explode(F.array(*[F.lit(c) for c in usable])))


def _json(c: Column) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"})


def _or_na(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("N/A"))


def notification_rows(alerts: DataFrame, channel: str, target: str = "", sent_at_us: Column | None = None) -> DataFrame:
    """``alert_id, channel, payload``: the JSON message of one channel. Nothing is sent.

    ``target`` is the chat channel or the paging key.
    """
    df = with_micros(alerts)
    kind = F.coalesce("alert_type", F.lit("Unknown"))
    severity = F.coalesce(_field(df, "severity"), F.lit("warning"))
    color = F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for kv in COLORS.items() for x in kv]), severity), F.lit("#FFA500")
    )
    score = F.coalesce(S.alert_score().cast("string"), F.lit("N/A"))
    seconds = F.floor(F.coalesce("timestamp", F.lit(0.0))).cast("long")

    def text(mark: str) -> Column:
        lines = {
            "Flow": F.concat(F.lit("`"), _or_na(F.col("flow_key")), F.lit("`")),
            "Severity": severity,
            "Source": F.concat(_or_na(F.col("src_ip")), F.lit(":"), _or_na(F.col("src_port"))),
            "Destination": F.concat(_or_na(F.col("dst_ip")), F.lit(":"), _or_na(F.col("dst_port"))),
            "Score": score,
            "Model": _or_na(F.col("model_version")),
        }
        return F.concat_ws("\n", *[F.concat(F.lit(f"{mark}{n}:{mark} "), v) for n, v in lines.items()])

    title = F.concat(F.lit("Network Anomaly: "), kind)
    if channel == "slack":
        stamp = F.struct(F.lit("Timestamp").alias("title"), iso(F.col("ts_us")).alias("value"), F.lit(True).alias("short"))
        model = F.struct(F.lit("Model").alias("title"), _or_na(F.col("model_version")).alias("value"), F.lit(True).alias("short"))
        attachment = F.struct(
            color.alias("color"), title.alias("title"), text("*").alias("text"),
            F.array(stamp, model).alias("fields"), F.lit("Network Anomaly Detection").alias("footer"), seconds.alias("ts"),
        )
        payload = F.struct(
            F.lit("anomaly-detector").alias("username"), F.lit(":warning:").alias("icon_emoji"),
            F.array(attachment).alias("attachments"), F.lit(target or "#security-alerts").alias("channel"),
        )
    elif channel == "mattermost":
        attachment = F.struct(color.alias("color"), title.alias("title"), text("**").alias("text"), seconds.alias("ts"))
        payload = F.struct(
            F.lit(target or "security-alerts").alias("channel"), F.lit("anomaly-detector").alias("username"),
            F.lit(":warning:").alias("icon_emoji"), F.array(attachment).alias("attachments"),
        )
    elif channel == "pagerduty":
        level = F.coalesce(
            F.element_at(F.create_map(*[F.lit(x) for kv in PAGE_SEVERITY.items() for x in kv]), severity), severity
        )
        details = [
            "flow_key", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "anomaly_score",
            "reconstruction_error", "anomaly_probability", "model_version", "src_ip_enrichment", "dst_ip_enrichment",
        ]
        payload = F.struct(
            F.lit(target).alias("routing_key"),
            F.lit("trigger").alias("event_action"),
            A.alert_hash().alias("dedup_key"),
            F.struct(
                F.concat(title, F.lit(" - "), _or_na(F.col("flow_key"))).alias("summary"),
                F.lit(SENSOR).alias("source"),
                level.alias("severity"),
                F.lit(SENSOR).alias("component"),
                F.lit("network-security").alias("group"),
                F.coalesce("alert_type", F.lit("unknown")).alias("class"),
                F.struct(*[_field(df, c).alias(c) for c in details]).alias("custom_details"),
            ).alias("payload"),
        )
    elif channel == "webhook":
        now = sent_at_us if sent_at_us is not None else F.unix_micros(F.current_timestamp())
        payload = F.struct(F.struct(*[F.col(c) for c in alerts.columns]).alias("alert"), (now / F.lit(1e6)).alias("timestamp"))
    else:
        raise ValueError(f"unknown channel {channel!r}")
    return df.select(A.alert_id().alias("alert_id"), F.lit(channel).alias("channel"), _json(payload).alias("payload"))


# --- P23, P24, J8, T1-T3 --------------------------------------------------------------
def filter_alerts(
    alerts: DataFrame,
    alert_type: str | None = None,
    severity: str | None = None,
    is_anomaly: bool | None = None,
    src_ip: str | None = None,
    dst_ip: str | None = None,
    flow_key: str | None = None,
    start: float | None = None,
    end: float | None = None,
) -> DataFrame:
    """Conjunction of the given criteria; empty or zero ones do not filter."""
    equal = {"alert_type": alert_type, "severity": severity and severity.lower(), "src_ip": src_ip, "dst_ip": dst_ip}
    for name, value in equal.items():
        if value:
            alerts = alerts.filter(F.col(name) == value)
    if is_anomaly is not None:
        alerts = alerts.filter(F.col("is_anomaly") == is_anomaly)
    if flow_key:
        alerts = alerts.filter(F.contains("flow_key", F.lit(flow_key)))
    if start:
        alerts = alerts.filter(F.col("timestamp") >= start)
    if end:
        alerts = alerts.filter(F.col("timestamp") <= end)
    return alerts


def filter_board(
    alerts: DataFrame,
    severities: Sequence[str] = BOARD_SEVERITIES,
    types: Sequence[str] = BOARD_TYPES,
    only_anomalies: bool = True,
    hours: int | None = None,
    now: float | None = None,
) -> DataFrame:
    """The dashboard's selectors; an empty list does not filter."""
    if severities:
        alerts = alerts.filter(F.lower("severity").isin(*severities))
    if types:
        any_type = F.lit(False)
        for t in types:
            any_type = any_type | F.contains("alert_type", F.lit(t))
        alerts = alerts.filter(any_type)
    if only_anomalies:
        alerts = alerts.filter("is_anomaly")
    if hours:
        upto = F.lit(now) if now else F.unix_micros(F.current_timestamp()) / F.lit(1e6)
        alerts = alerts.filter(F.col("timestamp") >= upto - hours * 3600)
    return alerts


def get_alert(alerts: DataFrame, alert_id: str) -> DataFrame:
    return alerts.filter(F.col("alert_id") == alert_id)


def page_alerts(alerts: DataFrame, sort_by: str = "timestamp", order: str = "desc", limit: int = 100, offset: int = 0, tie: str = "alert_id") -> DataFrame:
    """One page of alerts in a total order, with the number of all hits beside every row."""
    if not 1 <= limit <= 1000 or offset < 0 or order not in ("asc", "desc"):
        raise ValueError("limit must be 1..1000, offset >= 0, order asc or desc")
    first = F.desc(sort_by) if order == "desc" else F.asc(sort_by)
    total = alerts.agg(F.count(F.lit(1)).alias("n")).scalar()
    return alerts.orderBy(first, F.asc(tie)).offset(offset).limit(limit).withColumn("total", total)


def three_places(value: Column) -> Column:
    """The number rounded to three places as text.

    ``format_number`` takes 0.0005 for a tie and drops it; as a double it is a little more.
    """
    text = F.replace(F.format_number(value, 3), F.lit(","), F.lit(""))
    return F.when(value == 0.0005, "0.001").when(value == -0.0005, "-0.001").otherwise(text)


def latest_board(rows: DataFrame, n: int = 1000, tie: str = "alert_id") -> DataFrame:
    """The newest ``n`` rows as display columns."""
    newest = with_micros(rows).orderBy(F.desc("ts_us"), F.asc(tie)).limit(n)
    flow = F.col("flow_key")

    def end(side: str) -> Column:
        ip = F.col(f"{side}_ip")
        named = ip.isNotNull() & (F.octet_length(ip) > 0)
        return F.when(named, F.concat(ip, F.lit(":"), F.col(f"{side}_port"))).otherwise("N/A")

    return newest.select(
        F.date_format(F.timestamp_micros("ts_us"), "HH:mm:ss").alias("time"),
        F.col("alert_type").alias("type"),
        "severity",
        F.when(F.length(flow) > 30, F.concat(F.substring(flow, 1, 30), F.lit("..."))).otherwise(flow).alias("flow"),
        end("src").alias("source"),
        end("dst").alias("destination"),
        F.coalesce(three_places(S.alert_score()), F.lit("N/A")).alias("score"),
        F.coalesce(F.when(F.col("model_version") != "", F.col("model_version")), F.lit("N/A")).alias("model"),
        F.col("is_anomaly").alias("anomaly"),
    )


def top_terms(df: DataFrame, name: str, n: int = 10) -> DataFrame:
    """The ``n`` most frequent values; ties go to the smaller value."""
    counts = df.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("term")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc("term")).limit(n)


# --- A7, A8, K5 -------------------------------------------------------------------
def alert_stats(alerts: DataFrame, start: float | None = None, end: float | None = None, top: int = 10) -> DataFrame:
    """``dimension, term, n``: the total and the largest buckets by severity, type and outcome.

    The alerts are aggregated once; the dimensions are rolled up from that small result.
    """
    hits = filter_alerts(alerts, start=start, end=end)
    outcome = F.when(F.col("is_anomaly"), "success").otherwise("failure")
    cells = hits.groupBy("severity", "alert_type", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    terms = F.array(
        F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("term")),
        F.struct(F.lit("severity").alias("dimension"), F.col("severity").alias("term")),
        F.struct(F.lit("type").alias("dimension"), F.col("alert_type").alias("term")),
        F.struct(F.lit("outcome").alias("dimension"), F.col("outcome").alias("term")),
    )
    sums = (
        cells.select("n", F.inline(terms)).filter("term is not null").groupBy("dimension", "term").agg(F.sum("n").alias("n"))
    )
    rank = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), F.asc("term")))
    return sums.withColumn("_r", rank).filter(F.col("_r") <= top).drop("_r")


def alert_counters(alerts: DataFrame) -> DataFrame:
    """Total and anomalies per severity, with the overall row (severity null)."""
    return alerts.rollup("severity").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("is_anomaly", F.lit(False))).alias("anomalies")
    )


def retention_tier(alerts: DataFrame, as_of: Column | str, ts: str = "timestamp") -> DataFrame:
    """Add ``tier`` by age in days: hot, warm from 7, cold from 30, delete from 90."""
    when = F.to_timestamp(F.lit(as_of)) if isinstance(as_of, str) else as_of
    age = (F.unix_micros(when) / F.lit(1e6) - F.col(ts)) / 86400
    out = F.when(F.lit(False), F.lit("hot"))
    for days, tier in TIERS:
        out = out.when(age >= days, tier)
    return alerts.withColumn("tier", out.otherwise("hot"))
