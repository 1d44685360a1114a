"""De-duplication, correlation and chain on small alert sets, plans and the driver contract."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from flowspark.operators import alerts as O
from flowspark.plans import load_catalog
from flowspark.operators import flows
from flowspark.operators import training as T
from flowspark.operators.alerts import prepare_alerts
from flowspark.plans import views as V
from flowspark.plans.chain import alert_chain
from flowspark.streaming.stateless import observed

DDL = (
    "n int, alert_type string, flow_key string, timestamp double, is_anomaly boolean, src_ip string, dst_ip string, "
    "src_port int, dst_port int, protocol int, severity_in string"
)


def alerts(spark, rows):
    full = [(i, k, f, float(t), True, s, d, 5, 80, 6, None) for i, (k, f, t, s, d) in enumerate(rows)]
    return spark.createDataFrame(full, DDL)


def test_dedup_window_slides(spark):
    times = [1000, 1300, 1600, 1901, 2201, 2501.5]
    df = prepare_alerts(alerts(spark, [("fast_path", "f", t, "a", "b") for t in times]))
    assert sorted(r["n"] for r in O.dedup_alerts(df, 300, tie="n").collect()) == [0, 3, 5]
    merged = {r["n"]: (r["dedup_count"], r["last_seen_us"]) for r in O.dedup_alerts(df, 300, "merged", "n").collect()}
    assert merged == {0: (3, 1_600_000_000), 3: (2, 2_201_000_000), 5: (1, 2_501_500_000)}


def test_merge_keeps_the_highest_severity(spark):
    rows = [("k", 1, 100, "warning", ["a"], 0.1), ("k", 2, 200, "critical", ["b", "a"], 0.4), ("k", 3, 150, "info", ["c"], None)]
    df = spark.createDataFrame(rows, "dedup_key string, n int, ts_us long, severity string, correlated_alerts array<string>, correlation_score double")
    got = O.merge_duplicates(df, ["dedup_key"], "n").collect()[0]
    assert (got["dedup_count"], got["severity"], got["last_seen_us"], got["correlation_score"]) == (3, "critical", 200, 0.4)
    assert got["correlated_alerts"] == ["a", "c", "b"]


def test_suppress_seen(spark):
    df = spark.createDataFrame([("a", 1000 * 10**6), ("a", 1400 * 10**6), ("b", 5)], "dedup_key string, ts_us long")
    seen = spark.createDataFrame([("a", 900 * 10**6), ("a", 1000 * 10**6)], "dedup_key string, last_seen_us long")
    left = sorted((r["dedup_key"], r["ts_us"]) for r in O.suppress_seen(df, seen).collect())
    assert left == [("a", 1400 * 10**6), ("b", 5)]


def test_chain_emits_one_of_three_equal_alerts(spark):
    df = alerts(spark, [("deep_path_lstm_ae", "f", t, "10.0.0.1", "10.0.0.2") for t in (100, 101, 102)])
    dim = spark.createDataFrame([("10.0.0.0/8", 1, "big"), ("10.0.0.0/31", 2, "small")], "network string, asn long, country string")
    got = alert_chain(df, dim, tie="n").collect()
    assert len(got) == 1 and got[0]["severity"] == "error" and got[0]["output_topic"] == "alerts.error"
    assert got[0]["src_ip_enrichment"]["country"] == "small" and got[0]["dst_ip_enrichment"]["country"] == "big"
    assert got[0]["stix_indicator"]["type"] == "indicator"


def test_domain_lookup_overwrites(spark):
    df = prepare_alerts(alerts(spark, [("fast_path", "f", 1, "10.0.0.1", "9.9.9.9")]))
    dim = spark.createDataFrame([("10.0.0.0/8", "net")], "network string, country string")
    domains = spark.createDataFrame([("10.0.0.1", "dom")], "ip string, country string")
    got = O.enrich_ips(df, dim, domains).collect()[0]
    assert got["src_ip_enrichment"]["country"] == "dom" and got["dst_ip_enrichment"] is None


def test_one_source_three_detectors_are_linked(spark):
    kinds = ("fast_path", "deep_path", "xgboost_supervised")
    df = alerts(spark, [(k, f"f{i}", 100 + 2 * i, "198.51.100.50", f"192.168.1.{i}") for i, k in enumerate(kinds)])
    links = {(r["alert"], r["linked_to"]): r["score"] for r in O.correlation_links(df, tie="n").collect()}
    assert sorted(links) == [(1, 0), (2, 1)]
    # source, port, protocol and nearness match
    assert links[1, 0] == pytest.approx((0.15 + 0.1 + 0.05 + 0.1 * (1 - 2 / 3600)) / 4)


def test_basic_features(spark):
    rows = [(i * 500_000 if i < 9 else 5_000_000, "a" if i < 6 else "b", "b" if i < 6 else "a", 1 if i < 6 else 2, 2 if i < 6 else 1, 6, 100, b"", "", i, [2, 16, 0][i % 3], None, None) for i in range(10)]
    from flowspark.schemas import PACKET

    f = flows.flow_features(spark.createDataFrame(rows, PACKET)).collect()[0]
    assert (f["packets_total"], f["bytes_total"], f["packets_per_sec"], f["bytes_per_sec"]) == (10, 1000, 2.0, 200.0)
    assert (f["avg_pkt_size"], f["pkt_size_std"], f["fwd_rev_packet_ratio"], f["payload_entropy"]) == (100.0, 0.0, 1.5, 0.0)
    assert (f["tcp_syn_count"], f["tcp_ack_count"], f["tcp_fin_count"], len(f)) == (4, 3, 0, 37)
    single = flows.flow_features(spark.createDataFrame(rows[:1], PACKET)).collect()[0]
    assert (single["duration"], single["packets_per_sec"]) == (0.001, 1000.0)


@pytest.mark.parametrize("gap,sessions", [(300.0, 1), (300.1, 2), (301.0, 2)])
def test_session_boundary(spark, gap, sessions):
    from flowspark.schemas import PACKET

    rows = [(t, "a", "b", 1, 2, 6, 10, b"", "", n, 0, None, None) for n, t in enumerate((0, int(gap * 10**6)))]
    assert flows.flow_sessions(spark.createDataFrame(rows, PACKET)).count() == sessions


@pytest.mark.parametrize("keep", [None, lambda df: df.localCheckpoint()])
def test_sessions_from_chunk_sums(spark, keep):
    """Sessions over several chunks, whose tags come again in each; without a time; of null keys."""
    from flowspark.schemas import PACKET

    query = b"\x00\x01\x01\x00\x00\x01\x00\x00\x00\x00\x00\x00"
    times = [0, 200, 450, 700, 1100, 1101, None, None]
    rows = [(t and t * 10**6, a, "b", 9, 53, 17, 10 + n, query + bytes([n % 2]), "", n, 2, None, None) for a in ("a", None) for n, t in enumerate(times)]
    df = flows.flow_sessions(spark.createDataFrame(rows, PACKET), 300, keep=keep)
    got = [(r["start_time"], r["packets_total"], r["dns_query_count"], r["dns_unique_domains"], r["tcp_syn_count"]) for r in df.filter("src_ip = 'a'").collect()]
    assert sorted(got, key=str) == [(0.0, 4, 4, 2, 4), (1100.0, 2, 2, 2, 2), (None, 2, 2, 2, 2)]
    # once by chunk, once by flow; packets were joined with their sessions and then added up
    assert keep or exchanges(df) == 2
    assert df.count() == 6


def exchanges(df):
    df = df.withColumn("_k", F.lit(1))
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_rows_are_shuffled_once(spark, sf_dir):
    """One exchange of rows at most; the others carry chunk summaries (two) and partial aggregates."""
    assert exchanges(flows.flow_sessions(V.packets(spark, sf_dir), 300)) <= 4
    assert exchanges(flows.flow_vector51(V.packets(spark, sf_dir), 300)) <= 4
    assert exchanges(flows.active_idle(V.packets(spark, sf_dir))) <= 2
    alerts_ = prepare_alerts(V.detections(spark, sf_dir))
    assert exchanges(O.dedup_alerts(alerts_, tie="event_id")) <= 4
    plan = O.prepare_alerts(V.detections(spark, sf_dir)).select("severity")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_type:string>" in plan


def test_supervised_fit(spark):
    cols = {n: (F.rand(3) if i else F.col("id") % 2).cast("double") for i, n in enumerate(T.FEATURES)}
    df = spark.range(300).withColumns(cols).withColumn("label", F.col("id") % 2)
    fit = T.supervised_fit(df, "id", rounds=3, depth=2, flat_ok=True)
    got = {r["split"]: r["auc"] for r in fit.metrics.collect()}
    assert set(got) == {"train", "val", "test"} and min(got.values()) > 0.99 and fit.weight == pytest.approx(1.0, abs=0.05)
    top = T.feature_importance(fit.model).orderBy(F.desc("importance")).collect()
    assert top[0]["feature"] == "duration" and sum(r["importance"] for r in top) == pytest.approx(1.0)
    with pytest.raises(ValueError, match="too few"):
        T.supervised_fit(df.limit(50), "id", flat_ok=True)


def test_observed(spark):
    assert observed(spark.createDataFrame([(1, "x"), (2, None)], "n int, _error string"), "stage").count() == 2


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    core = load_catalog()
    assert len(core.QUERIES) >= 80 and len(set(core.QUERIES) - set(core.ORACLES)) <= 5
    assert entry.entry(spark).count() > 0
