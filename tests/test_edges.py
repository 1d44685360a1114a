"""Inputs that are easily got wrong: bad and IPv6 networks, domain attributes, one-class labels, very many hot keys."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from flowspark.functions.keys import ip_prefix, ipv4_to_long
from flowspark.operators import alerts as O
from flowspark.operators import monitor as M
from flowspark.operators.ordered import Ordered
from flowspark.operators import board as B
from flowspark.plans import views as V
from flowspark.sinks.tables import read_events, write_ecs
from flowspark.sources import cloud
from flowspark.sources.netflow import asof_templates


def test_ipv4_octets(spark):
    rows = ["10.0.0.1", "255.255.255.255", "10.300.1.1", "256.1.1.1", "1.2.3", "1.2.3.4.5", "a.b.c.d", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "ip string").select(ipv4_to_long("ip")).collect()]
    assert got == [int(ipaddress.ip_address("10.0.0.1")), 2**32 - 1] + [None] * 6


def test_prefixes_of_both_families(spark):
    rnd = random.Random(3)
    cases = []
    for _ in range(60):
        six = ipaddress.IPv6Address(rnd.getrandbits(128) & (rnd.getrandbits(128) if rnd.random() < 0.5 else ~0))
        cases.append((rnd.choice((six.exploded, six.compressed, six.compressed.upper())), rnd.randrange(129)))
    cases += [("::", 0), ("::1", 128), ("1::", 16), ("2001:db8::1", 32)]
    bad = [("1:2:3", 8), (":::", 8), ("1::2::3", 8), ("12345::", 8), ("g::", 8), ("::1", 129), ("1.2.3.4", 33), (":1", 4)]
    df = spark.createDataFrame(cases + bad, "ip string, n int").select("ip", "n", ip_prefix("ip", F.col("n")).alias("p"))
    for r in df.collect():
        if (r["ip"], r["n"]) in bad:
            assert r["p"] is None, r
            continue
        bits = int(ipaddress.IPv6Address(r["ip"])) >> (128 - r["n"]) << (128 - r["n"])
        groups = [bits >> (112 - 16 * i) & 0xFFFF for i in range(8)]
        cut = [g >> max(0, min(16, 16 * (i + 1) - r["n"])) for i, g in enumerate(groups)]
        assert r["p"] == "6:" + ":".join(f"{g:X}" for g in cut), r


def test_enrichment_with_bad_networks_and_domains(spark):
    bad = [(f"10.0.0.0/{n}", f"bad{n}") for n in range(33, 140)] + [("10.0.0.0", "none"), (None, "null"), ("10.0.0.0/x", "text")]
    dim = spark.createDataFrame(bad + [("10.0.0.0/8", "eight"), ("2001:db8::/32", "six"), ("0.0.0.0/0", "all")], "network string, country string")
    domains = spark.createDataFrame([("10.1.2.3", "example.org", "reg"), (None, "x", "y")], "ip string, domain string, registrar string")
    rows = spark.createDataFrame([("10.1.2.3", "2001:db8::1"), ("9.9.9.9", None), ("::1", "nonsense")], "src_ip string, dst_ip string")
    got = {r["src_ip"]: r for r in O.enrich_ips(rows, dim, domains).collect()}
    one = got["10.1.2.3"]
    assert (one["src_ip_enrichment"]["country"], one["src_ip_enrichment"]["domain"], one["src_ip_enrichment"]["registrar"]) == ("eight", "example.org", "reg")
    assert one["dst_ip_enrichment"]["country"] == "six"
    assert got["9.9.9.9"]["src_ip_enrichment"]["country"] == "all"
    assert got["::1"]["src_ip_enrichment"] is None and got["::1"]["dst_ip_enrichment"] is None


@pytest.mark.parametrize("labels", [(1, 1), (0, 0), ()])
def test_evaluation_of_one_class(spark, labels):
    df = spark.createDataFrame([(0.3 + i / 2, y) for i, y in enumerate(labels)], "s double, y int")
    row = M.evaluate(df, "s", "y").first()
    assert row["auc"] is None and row["precision"] == (1.0 if 1 in labels else 0.0)


def test_all_hot_keys_are_split(spark):
    df = spark.range(1500 * 6).select(
        F.concat(F.lit("k"), F.col("id") % 1500).alias("key"), (F.xxhash64("id") % 1000).alias("ts_us"), F.col("id").alias("n"), (F.col("id") % 7).alias("v")
    )
    df = df.unionByName(df.limit(40).withColumn("key", F.lit(None).cast("string")))
    ordered = Ordered(df, ["key"], ["ts_us", "n"], width=100).running(s=("sum", "v"))
    window = Window.partitionBy("key").orderBy("ts_us", "n").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.filter("key is not null").withColumn("s", F.sum("v").over(window))
    got = ordered.result().filter("key is not null").select(*plain.columns)
    assert got.exceptAll(plain).count() == 0 and got.count() == plain.count()


def test_templates_meet_near_rows_only(spark):
    hour = 3_600_000_000
    templates = spark.createDataFrame([("e", 1, k * hour // 2, [(8, k)]) for k in range(40)], "exporter string, template_id int, seen_us long, spec array<struct<ftype int, flen int>>")
    data = spark.createDataFrame([("e", 1, t * hour // 7) for t in range(-5, 170)], "exporter string, template_id int, ts_us long")
    got = {r["ts_us"]: r["spec"][0]["flen"] for r in asof_templates(data, templates).collect()}
    want = {}
    for t in range(-5, 170):
        ts = t * hour // 7
        seen = [k for k in range(40) if k * hour // 2 <= ts]
        if seen and ts - seen[-1] * hour // 2 <= hour:
            want[ts] = seen[-1]
    assert got == want


def test_event_store_round_trip(spark, sf_dir, tmp_path):
    alerts = O.prepare_alerts(V.detections(spark, sf_dir)).cache()
    write_ecs(alerts, str(tmp_path / "events"))
    flat = O.with_micros(alerts).withColumn("timestamp", F.col("ts_us") / 1e6)
    events = read_events(spark, str(tmp_path / "events"))
    cols = ["alert_id", "ts_us", "alert_type", "severity", "is_anomaly", "src_ip", "dst_ip"]
    key = lambda df: sorted(map(str, df.select(*cols).collect()))
    assert key(events) == key(flat)
    low, high = flat.agg(F.percentile_approx("timestamp", [0.2, 0.4])).first()[0]
    some = read_events(spark, str(tmp_path / "events"), low, high)
    assert key(some) == key(B.filter_alerts(flat, start=low, end=high))
    plan = B.filter_alerts(some, severity="critical")._jdf.queryExecution().executedPlan().toString()
    pruned = plan[plan.index("PartitionFilters") :].split("PushedFilters")[0]
    assert "day" in pruned and "severity" in pruned
    page = B.page_alerts(some, limit=5).select("alert_id", "total").collect()
    assert page == B.page_alerts(B.filter_alerts(flat, start=low, end=high), limit=5).select("alert_id", "total").collect()
    stats = lambda df: sorted(map(tuple, B.alert_stats(df).collect()), key=str)
    assert stats(events) == stats(flat)


def test_cloud_files(spark, tmp_path):
    import gzip
    import json

    line = "2 123456789010 eni-1 10.0.0.1 10.0.0.2 20641 22 6 20 4249 1418530010 1418530070 ACCEPT OK"
    (tmp_path / "aws").mkdir()
    with gzip.open(tmp_path / "aws/a.log.gz", "wt") as f:
        f.write(f"version account-id interface-id\n{line}\nbroken\n")
    got = cloud.read_aws_flow(spark, str(tmp_path / "aws")).collect()
    assert [(r["src_ip"], r["dst_port"]) for r in got] == [("10.0.0.1", 22)]
    tuples = ["1542110377,10.0.0.4,13.67.143.118,44931,443,6,O,A", "1,a,b,1,2,3,I", "x,a,b,1,2,3,I,A", "1,a,b,1,2,3,,A"]
    doc = {"records": [{"time": "t", "resourceId": "r", "properties": {"flows": [{"rule": "q", "flows": [{"mac": "m", "flowTuples": tuples}]}]}}]}
    (tmp_path / "azure").mkdir()
    (tmp_path / "azure/PT1H.json").write_text(json.dumps(doc, indent=1))
    got = cloud.read_azure_flow(spark, str(tmp_path / "azure")).collect()
    assert [(r["src_ip"], r["dst_port"], r["rule"]) for r in got] == [("10.0.0.4", 443, "q")]


def test_score_text_of_half_a_thousandth(spark):
    """0.0005 is a little more than half a thousandth as a double; it was shown as 0.000."""
    from flowspark.operators.board import three_places

    values = [0.0005, -0.0005, 0.0015, 0.0625, 0.1235, 1234.5678, 0.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(three_places(F.col("v"))).collect()]
    assert got == [None if v is None else f"{v:.3f}" for v in values]
