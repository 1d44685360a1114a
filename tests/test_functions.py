"""Expected values of the column functions."""

import base64
import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from flowspark.functions import alerts as A
from flowspark.functions import keys as K
from flowspark.functions import packets as P
from flowspark.functions import scores as S
from flowspark.functions import vectors as X
from flowspark.functions.times import epoch_from_rfc3339, iso, zeek_ts
from flowspark.operators import board as B
from flowspark.operators import monitor as M
from flowspark.operators import training as T
from flowspark.schemas import FEATURES


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).collect()[0])


def test_feature_order():
    assert len(FEATURES) == len(set(FEATURES)) == 51
    assert (FEATURES[0], FEATURES[3], FEATURES[50]) == ("duration", "fwd_bytes", "idle_min")


def test_canonical_flow(spark):
    rows = [("10.0.0.1", "10.0.0.2", 5, 80, 6), ("10.0.0.2", "10.0.0.1", 80, 5, 6), ("10.0.0.1", "10.0.0.2", 5, 80, 17),
            ("10.0.0.1", "10.0.0.1", 1, 2, 6)]
    df = K.canonical_flow(spark.createDataFrame(rows, "src_ip string, dst_ip string, src_port int, dst_port int, protocol int"))
    got = [tuple(r) for r in df.select(K.flow_id(), K.is_forward(), K.directed_key(), K.reverse_key()).collect()]
    assert got[0][0] == got[1][0] == "10.0.0.1:5-10.0.0.2:80-6" and got[2][0] != got[0][0]
    assert [g[1] for g in got] == [True, False, True, False]
    assert got[0][2:] == ("10.0.0.1:5->10.0.0.2:80/6", "10.0.0.2:80->10.0.0.1:5/6")
    assert got[3][0] == "10.0.0.1:2-10.0.0.1:1-6"


def test_protocols_flags_addresses(spark):
    protos = [F.lit(n) for n in (6, 17, 1, 58, 47, 999)]
    assert one(spark, *[K.protocol_name(p) for p in protos]) == ("TCP", "UDP", "ICMP", "ICMPV6", "47", "999")
    assert one(spark, *[K.protocol_name(p, "ecs") for p in protos]) == ("tcp", "udp", "icmp", "58", "gre", "999")
    assert one(spark, K.protocol_name(F.lit(None).cast("int"), "ecs")) == (None,)
    assert one(spark, K.tcp_flag_names(F.lit(0x53)), K.tcp_flag_names(F.lit(0))) == (["FIN", "SYN", "ACK", "ECE"], [])
    assert one(spark, K.strip_mapped_ipv4(F.lit("::ffff:1.2.3.4")), K.strip_mapped_ipv4(F.lit("::1"))) == ("1.2.3.4", "::1")
    assert one(spark, K.ipv4_to_long(F.lit("10.0.1.2")), K.ipv4_to_long(F.lit("::1"))) == (167772418, None)
    assert one(spark, K.long_to_ipv4(F.lit(167772418))) == ("10.0.1.2",)


@pytest.mark.parametrize("data,want", [(b"\0" * 256, 0.0), (bytes(range(256)), 8.0), (b"", 0.0), (b"ab", 1.0)])
def test_entropy(spark, data, want):
    for limit in (256, None):
        assert one(spark, P.payload_entropy(F.lit(data), limit))[0] == pytest.approx(want)
    assert one(spark, P.payload_entropy(F.lit(data + b"x" * 256), 0 or 256))[0] <= 8.0


def test_app_layer(spark):
    dns = b"\xaa\xbb\x01\x00" + b"\0" * 80
    rows = [
        (1, 5000, 80, b"GET / HTTP/1.1\r\nHost: a.b\xff\r\nHost: c\r\n"),
        (2, 5000, 80, b"GET / HTTP/1.1\r\nHost: a.b"),
        (3, 5000, 9999, b"GET / HTTP/1.1\r\nHost: a.b\r\n"),
        (4, 5000, 8000, b"POST / HTTP/1.1\r\nHost: \r\n"),
        (5, 53, 5000, dns),
        (6, 5000, 53, dns[:11]),
        (7, 5000, 443, b"\x16\x03"),
        (8, 443, 5000, b"\x16\x03"),
    ]
    df = spark.createDataFrame(rows, "n int, src_port int, dst_port int, payload binary")
    got = {r["n"]: r for r in P.tag_app_layer(df).collect()}
    assert [got[i]["http_host"] for i in range(1, 6)] == ["a.b", None, None, "", None]
    assert bytes(got[5]["dns_query"]) == dns[:64] and got[6]["dns_query"] is None
    assert (got[7]["tls"], got[8]["tls"]) == ("handshake", None)


def test_scores(spark):
    e = [(0.1, 0.5, None), (0.9, 0.5, None), (0.75, 0.5, 1.0), (10.0, 0.5, 1.0), (0.2, 0.5, 1.0), (0.9, 0.5, 0.4)]
    got = one(spark, *[S.normalize_score(F.lit(a), t, m).alias(f"c{i}") for i, (a, t, m) in enumerate(e)])
    assert got == (0.0, 1.0, 0.5, 1.0, 0.0, 1.0)
    assert one(spark, S.confidence(F.lit(0.5), -0.5), S.confidence(F.lit(0.6), 0.5))[0] == 1.0
    assert one(spark, *[S.risk_score(F.lit(s)) for s in ("critical", "error", "warning", "info", "debug", "odd")]) == (80, 60, 40, 10, 0, 40)
    assert one(spark, S.risk_score(F.lit(None).cast("string"))) == (None,)
    types = ("fast_path", "deep_path_lstm_ae", "xgboost_supervised", "other", "my_fast_path_deep_path")
    assert one(spark, *[S.severity_from_type(F.lit(t)) for t in types]) == ("warning", "error", "critical", "warning", "warning")
    assert one(spark, *[S.route(F.lit(s)) for s in ("critical", "warning", "odd")]) == ("alerts.critical", "alerts.warning", "alerts.warning")


def test_vectors(spark):
    v, m, z = X.literal_vector([10, 20, 30]), X.literal_vector([5, 10, 15]), X.literal_vector([5, 10, 0])
    assert one(spark, X.zscore(v, m, m), X.zscore(v, m, z)) == ([1.0, 1.0, 1.0], [1.0, 1.0, 0.0])
    with pytest.raises(Exception, match="differ in length"):
        one(spark, X.zscore(v, X.literal_vector([1]), m))
    all51 = X.literal_vector(range(51))
    assert one(spark, X.select_features(all51, ["duration", "nope", "fwd_bytes"])) == ([0.0, 3.0],)
    assert one(spark, X.vector_error(X.literal_vector([1, 2]), X.literal_vector([3, 4]))) == (4.0,)
    assert one(spark, X.vector_error(v, v)) == (0.0,)
    seq = F.array(X.literal_vector([1, 2]), X.literal_vector([3, 4]))
    assert one(spark, X.zscore_sequence(seq, X.literal_vector([0, 0]), X.literal_vector([1, 1]))) == ([[1, 2], [3, 4]],)
    assert one(spark, X.zscore_sequence(seq, X.literal_vector([0, 0]), X.literal_vector([0, 0]))) == ([[0, 0], [0, 0]],)


def test_strict_lenient_labelled(spark):
    whole = {n: float(i) for i, n in enumerate(FEATURES)}
    rows = [
        (0, {k: str(v) for k, v in whole.items()}, "0"),
        (1, {k: str(v) for k, v in whole.items() if k != "fwd_bytes"}, "1"),
        (2, {**{k: str(v) for k, v in whole.items()}, "duration": "x"}, "1"),
        (3, None, "1"),
        (4, {k: str(v) for k, v in reversed(whole.items())}, "1"),
        (5, {k: str(v) for k, v in whole.items()}, "2"),
        (6, {k: str(v) for k, v in whole.items()}, None),
    ]
    df = spark.createDataFrame(rows, "n int, features map<string,string>, label string")
    strict = {r["n"]: r["vec"] for r in X.strict_vector(df, flat_ok=False).collect()}
    assert sorted(strict) == [0, 4, 5, 6] and strict[0] == strict[4] == [float(i) for i in range(51)]
    lenient = {r["n"]: r["vec"] for r in X.lenient_vector(df).collect()}
    assert lenient[1][3] == 0.0 and lenient[2][0] == 0.0 and lenient[3] == [0.0] * 51 and lenient[1][4] == 4.0
    assert sorted((r["n"], r["y"]) for r in X.labelled_vectors(df).collect()) == [(0, 0), (4, 1)]
    flat = spark.createDataFrame([tuple(whole.values())], ", ".join(f"{n} double" for n in FEATURES))
    assert X.strict_vector(flat).count() == 1 and X.strict_vector(flat.drop("duration")).count() == 0


@pytest.mark.parametrize("labels,want", [([0, 1, 0, 1], 1.0), ([0] * 10 + [1] * 2, 5.0), ([0, 0], 1.0)])
def test_class_weight(spark, labels, want):
    df = spark.createDataFrame([(y,) for y in labels], "y int")
    assert T.class_weight(df).collect()[0][0] == want


def alert_rows(spark, rows):
    ddl = "alert_type string, flow_key string, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, is_anomaly boolean, severity string"
    return spark.createDataFrame(rows, ddl)


def test_keys_and_hashes(spark):
    rows = [("fast_path", 'f"\\é€😀\n', "1.1.1.1", None, 5, None, 6, True, "warning"), ("t", "k", "a", "b", 1, 2, 6, False, "error")]
    got = alert_rows(spark, rows).select(A.dedup_key(), A.alert_hash(), A.dedup_key(("flow_key", "alert_type")), A.dedup_key(("alert_type", "flow_key")), A.single_correlation_id()).collect()
    for row, g in zip(rows, got, strict=True):
        names = ("alert_type", "flow_key", "src_ip", "dst_ip", "src_port", "dst_port")
        given = dict(zip(names, row, strict=False))
        text = "|".join(sorted(f"{k}={v}" for k, v in given.items() if v is not None))
        assert g[0] == hashlib.sha256(text.encode()).hexdigest()[:32]
        assert g[1] == hashlib.sha256(json.dumps(given, sort_keys=True).encode()).hexdigest()[:16]
        assert g[2] == g[3]
        pair = f"{row[2]}->{row[3]}" if row[2] and row[3] else ""
        assert g[4] == hashlib.sha256(f"flows={row[1]}|ips={pair}".encode()).hexdigest()[:16]


def test_stix(spark):
    rows = [("t", "k", "1.1.1.1", "2.2.2.2", 0, 80, 6, True, "error"), ("t", "k", "a", "b", 1, 2, 6, False, "error"), ("t", "k", None, "", 0, None, 6, True, "error")]
    got = [r[0] for r in alert_rows(spark, rows).select(A.stix_indicator(F.lit(1_500_000))).collect()]
    assert got[0]["pattern"] == "[ipv4-addr:value = '1.1.1.1'] OR [ipv4-addr:value = '2.2.2.2'] OR [network-traffic:dst_port = 80]"
    assert got[0]["id"] == "indicator--k" and got[0]["created"] == "1970-01-01T00:00:01.500000Z"
    assert got[1] is None and got[2] is None


def test_correlation_score(spark):
    def alert(flow, src, dst, port, proto, t):
        return F.struct(F.lit(flow).alias("flow_key"), F.lit(src).alias("src_ip"), F.lit(dst).alias("dst_ip"), F.lit(port).alias("dst_port"),
                        F.lit(proto).alias("protocol"), F.lit(t * 1_000_000).cast("long").alias("ts_us"))

    a = alert("f", "s", "d", None, None, 0)
    got = one(
        spark,
        A.correlation_score(a, alert("f", "s", "d", None, None, 1)),
        A.correlation_score(a, alert("g", "s", "d", None, None, 1)),
        A.correlation_score(a, alert("g", "x", "y", None, None, 9999)),
        A.correlation_score(a, alert("g", "s", "y", 1, 6, 1)),
    )
    assert 0.29 < got[0] < 0.31 and 0.19 < got[1] < 0.21 and got[2] == 0.0
    assert got[3] == pytest.approx((0.15 + 0.1 * (1 - 1 / 3600)) / 2)


def test_times(spark):
    got = one(spark, epoch_from_rfc3339(F.lit("2024-01-01T00:00:00.5Z")), epoch_from_rfc3339(F.lit("2024-01-01T02:00:00+02:00")), epoch_from_rfc3339(F.lit("soon")))
    assert got == (1704067200.5, 1704067200.0, 0.0)
    assert one(spark, zeek_ts(F.lit("1.25")), zeek_ts(F.lit("-")), iso(F.lit(1_000_000))) == (1.25, 0.0, "1970-01-01T00:00:01")


def test_ecs_and_messages(spark):
    ddl = (
        "alert_id string, alert_type string, flow_key string, timestamp double, is_anomaly boolean, src_ip string, dst_ip string, src_port int, "
        "dst_port int, protocol int, anomaly_score double, reconstruction_error double, anomaly_probability double, model_version string, "
        "inference_time_ms double, severity string, dedup_key string, "
        "src_ip_enrichment struct<asn:bigint,asn_description:string,country:string,city:string,latitude:double,longitude:double>, "
        "dst_ip_enrichment struct<asn:bigint,asn_description:string,country:string,city:string,latitude:double,longitude:double>"
    )
    row = ("f_1", "fast_path", "f", 1.5, True, "1.1.1.1", "2.2.2.2", 5, 80, 6, 0.0, 0.25, None, None, 2.0, "critical", "dk", (15169, "Org", "US", "City", 1.0, None), None)
    df = spark.createDataFrame([row], ddl)
    e = B.ecs_event(df).collect()[0]
    assert e["event"]["kind"] == "alert" and e["event"]["category"] == ["network", "intrusion_detection"] and e["event"]["risk_score"] == 80
    assert e["network"]["protocol"] == "tcp" and e["rule"]["name"] == "Fast Path" and e["alert"]["score"] == 0.25
    assert e["correlation"]["group_id"] == "dk" and e["observer"]["version"] == "unknown" and e["timestamp"] == "1970-01-01T00:00:01.500000Z"
    assert e["source"]["geo"]["country_iso_code"] == "US" and e["source"]["geo"]["location"] is None and e["source"]["as"]["number"] == 15169
    assert e["destination"]["geo"] is None
    sent = {c: json.loads(B.notification_rows(df, c, sent_at_us=F.lit(0)).collect()[0]["payload"]) for c in ("slack", "mattermost", "pagerduty", "webhook")}
    assert sent["slack"]["attachments"][0]["color"] == "#FF0000" and "*Score:* 0.25" in sent["slack"]["attachments"][0]["text"]
    assert "**Flow:** `f`" in sent["mattermost"]["attachments"][0]["text"] and sent["mattermost"]["attachments"][0]["ts"] == 1
    assert sent["pagerduty"]["event_action"] == "trigger" and sent["pagerduty"]["payload"]["severity"] == "critical"
    assert sent["pagerduty"]["payload"]["custom_details"]["anomaly_probability"] is None
    assert sent["webhook"]["alert"]["flow_key"] == "f"
    board = B.latest_board(B.board_rows(df)).collect()[0]
    assert (board["time"], board["score"], board["model"], board["source"]) == ("00:00:01", "0.250", "N/A", "1.1.1.1:5")


def test_severity_and_channels(spark):
    df = spark.createDataFrame([("debug",), ("WARNING",), ("odd",), ("error",), (None,)], "severity string")
    assert B.min_severity(df).count() == 4 and B.min_severity(df, "error").count() == 1
    assert B.fan_out_channels(df, ["slack", "webhook", "email"], ["webhook", "slack"]).count() == 10
    assert B.fan_out_channels(df, ["slack"], []).count() == 0


def test_evaluate(spark):
    import random

    rnd = random.Random(3)
    rows = [(round(rnd.random(), 1), rnd.randrange(2)) for _ in range(200)]
    got = M.evaluate(spark.createDataFrame(rows, "s double, y int"), "s", "y", 0.5).collect()[0]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
    tp, fp = sum(s > 0.5 for s in pos), sum(s > 0.5 for s in neg)
    assert got["auc"] == pytest.approx(auc) and got["precision"] == pytest.approx(tp / (tp + fp)) and got["recall"] == pytest.approx(tp / len(pos))
    cuts = sorted({s for s, _ in rows}, reverse=True)
    fpr = min(sum(s >= c for s in neg) / len(neg) for c in cuts if sum(s >= c for s in pos) / len(pos) >= 0.95)
    assert got["fpr_at_tpr"] == pytest.approx(fpr)


def test_psi(spark):
    ref = spark.createDataFrame([(float(i % 10),) for i in range(100)], "a double")
    cur = spark.createDataFrame([(float(i % 5),) for i in range(100)], "a double")
    same = M.psi_drift(ref, ref, ["a"]).collect()[0]
    moved = M.psi_drift(ref, cur, ["a"]).collect()[0]
    assert same["psi"] == pytest.approx(0.0) and not same["drifted"] and moved["drifted"] and math.isfinite(moved["psi"])
    assert base64.b64encode(b"") == b""
