"""Alert keys, hashes, indicators and pairwise correlation as expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowspark.functions.keys import col
from flowspark.functions.times import iso
from flowspark.schemas import DEDUP_FIELDS


def alert_id(flow_key: str | Column = "flow_key", timestamp: str | Column = "timestamp") -> Column:
    """``flow_key_<whole milliseconds>``."""
    ms = (col(timestamp) * 1000).cast("long")
    return F.concat(F.coalesce(col(flow_key), F.lit("")), F.lit("_"), ms)


def dedup_key(fields: Sequence[str] = DEDUP_FIELDS) -> Column:
    """sha256 (32 hex) of the sorted ``field=value`` parts that are not null."""
    parts = [
        F.when(F.col(f).isNotNull(), F.concat(F.lit(f"{f}="), F.col(f).cast("string"))) for f in fields
    ]
    joined = F.concat_ws("|", F.array_sort(F.array_compact(F.array(*parts))))
    return F.substring(F.sha2(joined, 256), 1, 32)


def json_string(c: Column) -> Column:
    """JSON string literal with non-ASCII characters escaped; null gives ``null``."""
    simple = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    units = F.hex(F.encode(c, "UTF-16BE"))
    starts = F.sequence(F.lit(1), F.greatest(F.length(units) - 3, F.lit(1)), F.lit(4))

    def escape(i: Column) -> Column:
        unit = F.lower(F.substring(units, i, F.lit(4)))
        code = F.conv(unit, 16, 10).cast("int")
        return (
            F.when(unit == "0022", '\\"')
            .when(unit == "005c", "\\\\")
            .when(unit == "0008", "\\b")
            .when(unit == "0009", "\\t")
            .when(unit == "000a", "\\n")
            .when(unit == "000c", "\\f")
            .when(unit == "000d", "\\r")
            .when((code >= 32) & (code < 127), F.char(code))
            .otherwise(F.concat(F.lit("\\u"), unit))
        )

    body = F.when(c.rlike(r"\A[\x20-\x7e]*\z"), simple).otherwise(
        F.array_join(F.transform(starts, escape), "")
    )
    return F.when(c.isNull(), "null").otherwise(F.concat(F.lit('"'), body, F.lit('"')))


def alert_hash() -> Column:
    """sha256 (16 hex) of the key-sorted JSON object of the six identity fields."""
    fields = sorted(DEDUP_FIELDS)
    parts: list[Column] = []
    for i, name in enumerate(fields):
        lead = ("{" if i == 0 else ", ") + f'"{name}": '
        if name.endswith("_port"):
            value = F.coalesce(F.col(name).cast("string"), F.lit("null"))
        else:
            value = json_string(F.col(name))
        parts += [F.lit(lead), value]
    return F.substring(F.sha2(F.concat(*parts, F.lit("}")), 256), 1, 16)


def _present(c: Column) -> Column:
    return c.isNotNull() & (F.octet_length(c) > 0)


def _nonzero(c: Column) -> Column:
    return c.isNotNull() & (c != 0)


def stix_indicator(as_of_us: Column | None = None) -> Column:
    """STIX 2.1 indicator struct for anomalies with at least one endpoint; otherwise null."""
    src, dst = F.col("src_ip"), F.col("dst_ip")
    parts = F.array_compact(
        F.array(
            F.when(_present(src), F.concat(F.lit("[ipv4-addr:value = '"), src, F.lit("']"))),
            F.when(_present(dst), F.concat(F.lit("[ipv4-addr:value = '"), dst, F.lit("']"))),
            F.when(
                _nonzero(F.col("src_port")),
                F.concat(F.lit("[network-traffic:src_port = "), F.col("src_port"), F.lit("]")),
            ),
            F.when(
                _nonzero(F.col("dst_port")),
                F.concat(F.lit("[network-traffic:dst_port = "), F.col("dst_port"), F.lit("]")),
            ),
        )
    )
    now = iso(as_of_us if as_of_us is not None else F.unix_micros(F.current_timestamp()), "Z")
    kind = F.col("alert_type")
    indicator = F.struct(
        F.lit("indicator").alias("type"),
        F.lit("2.1").alias("spec_version"),
        F.concat(F.lit("indicator--"), F.coalesce(F.col("flow_key"), F.lit(""))).alias("id"),
        now.alias("created"),
        now.alias("modified"),
        F.concat(F.lit("Network Anomaly: "), kind).alias("name"),
        F.concat(F.lit("Detected by "), kind, F.lit(" with severity "), F.col("severity")).alias("description"),
        F.array(F.lit("malicious-activity"), F.lit("anomalous-activity")).alias("indicator_types"),
        F.array_join(parts, " OR ").alias("pattern"),
        F.lit("stix").alias("pattern_type"),
        now.alias("valid_from"),
        F.array(F.lit("network-anomaly"), kind).alias("labels"),
    )
    return F.when(F.col("is_anomaly") & (F.size(parts) > 0), indicator)


# fixed values: correlation points
POINTS = {"flow": 0.5, "pair": 0.3, "either": 0.15, "port": 0.1, "protocol": 0.05, "time": 0.1}
CORRELATION_FIELDS = ("flow_key", "src_ip", "dst_ip", "dst_port", "protocol", "ts_us")


def correlation_score(a: Column, b: Column) -> Column:
    """Mean of the matched factors' points for two alert structs (``CORRELATION_FIELDS``)."""

    def same(f: str, present) -> Column:
        return F.coalesce(present(a[f]) & (a[f] == b[f]), F.lit(False))

    flow = same("flow_key", _present)
    src, dst = same("src_ip", _present), same("dst_ip", _present)
    port, proto = same("dst_port", _nonzero), same("protocol", _nonzero)
    gap = F.abs(a["ts_us"] - b["ts_us"]) / F.lit(1e6)
    near = gap < 3600

    def on(cond: Column, points: Column | float) -> Column:
        return F.when(cond, points).otherwise(F.lit(0.0))

    points = (
        on(flow, POINTS["flow"])
        + F.when(src & dst, POINTS["pair"]).when(src | dst, POINTS["either"]).otherwise(0.0)
        + on(port, POINTS["port"])
        + on(proto, POINTS["protocol"])
        + on(near, F.lit(POINTS["time"]) * (1 - gap / 3600))
    )
    factors = sum((f.cast("int") for f in (flow, src | dst, port, proto, near)), F.lit(0))
    return points / F.greatest(factors, F.lit(1))


def single_correlation_id() -> Column:
    """Correlation id of a set holding only this alert."""
    flow = F.when(_present(F.col("flow_key")), F.col("flow_key")).otherwise("")
    both = _present(F.col("src_ip")) & _present(F.col("dst_ip"))
    pair = F.when(both, F.concat(F.col("src_ip"), F.lit("->"), F.col("dst_ip"))).otherwise("")
    text = F.concat(F.lit("flows="), flow, F.lit("|ips="), pair)
    return F.substring(F.sha2(text, 256), 1, 16)
