"""Readers over small files and hand-made binary, and the writers."""

import gzip
import random
import struct

import pytest
from pyspark.sql import functions as F

from flowspark.operators import detect as D
from flowspark.operators import sequences as Q
from flowspark.operators import training as T
from flowspark.operators.alerts import prepare_alerts
from flowspark.plans import views as V
from flowspark.sinks import tables as K
from flowspark.operators import training as TR
from flowspark.sources import cloud, netflow, pcap, tables, zeek


def test_aws_lines(spark):
    base = "2 a e 1.1.1.1 2.2.2.2 5 80 6 10 20 100 90 REJECT OK"
    v3 = "3" + base[1:] + " p q - 7 18 IPv4 r z s v"
    lines = [base, "  " + base.replace(" ", "\t") + "\n", v3, v3.replace(" 7 ", " x "), "4" + v3[1:] + " i sv dv egress", base.replace("80", "y"),
             "1" + base[1:], "2 a", "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "n int, line string")
    got = {r["n"]: r for r in cloud.aws_derived(cloud.parse_aws_flow(df)).collect()}
    assert sorted(got) == [0, 1, 2, 4]
    assert got[0]["is_rejected"] and got[0]["duration_s"] == 0 and got[0]["pkt_src_ip"] is None
    assert got[2]["pkt_src_port"] is None and got[2]["pkt_dst_port"] == 7 and got[4]["direction"] == "egress" and got[2]["instance_id"] is None
    bad = {r["n"]: r["_error"] for r in tables.split_bad(cloud.parse_aws_flow(df, keep_bad=True))[1].collect()}
    assert bad == {3: "not a number", 5: "not a number", 6: "version below 2", 7: "too few fields", 8: "too few fields", 9: "too few fields"}


def test_gcp_lines(spark):
    lines = ['{"src_ip": "a", "src_port": 5}', '{"jsonPayload": {"src_ip": "b", "dst_port": "7", "reporter": "SRC"}}', '{"src_port": null}',
             '{"src_port": "x"}', "nonsense", '{"start_time": null, "tcp_flags_syn": true}', "{}"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "n int, line string")
    got = {r["n"]: r for r in cloud.parse_gcp_flow(df).collect()}
    assert sorted(got) == [0, 1, 5, 6]
    assert (got[0]["src_ip"], got[0]["src_port"], got[0]["dst_port"], got[0]["dst_ip"]) == ("a", 5, 0, "")
    assert (got[1]["src_ip"], got[1]["dst_port"], got[1]["reporter"]) == ("b", 7, "SRC")
    assert got[5]["start_time"] is None and got[5]["tcp_flags_syn"] and got[6]["start_time"] == "" and not got[6]["tcp_flags_syn"]
    bad = {r["n"]: r["_error"] for r in cloud.parse_gcp_flow(df, keep_bad=True).filter("_error is not null").collect()}
    assert bad == {2: "not a number", 3: "not a number", 4: "not a JSON object"}


def test_zeek_files(spark, tmp_path):
    (tmp_path / "conn.log").write_bytes(b"#fields\tts\tuid\n1.5\tC1\n#close\nx\tC2\textra\n\n2\tC\xff\n")
    with gzip.open(tmp_path / "other.log.gz", "wb") as f:
        f.write(b"#separator x\n#fields\tts\tquery\tqtype\trcode\n3.0\tq,r\n")
    (tmp_path / "bare.log").write_text("no header\n")
    df = zeek.normalize_zeek(zeek.read_zeek(spark, str(tmp_path)))
    got = sorted((r["log_type"], r["line_number"], r["timestamp"], r["fields_raw"]) for r in df.collect())
    assert got == [
        ("conn", 1, 1.5, {"ts": "1.5", "uid": "C1"}),
        ("conn", 3, 0.0, {"ts": "x", "uid": "C2"}),
        ("conn", 4, 0.0, {"ts": "", "uid": ""}),
        ("conn", 5, 2.0, {"ts": "2", "uid": "C�"}),
        ("dns", 1, 3.0, {"ts": "3.0", "query": "q,r", "qtype": "", "rcode": ""}),
    ]
    values = {r[0]: r[1] for r in df.select("fields_raw.ts", F.col("fields")["query"]["arr"]).collect()}
    assert values["3.0"] == ["q", "r"]


def test_zeek_values(spark):
    cases = {"-": None, "": None, "T": "bool", "F": "bool", "a, b": "list", "1.5": "double", "1.2.3.4": "string", "7": "int", "x": "string", "1e5": "string"}
    df = spark.createDataFrame([({k: v for v, k in zip(cases, "abcdefghij", strict=True)},)], "fields_raw map<string,string>")
    fields = zeek.normalize_zeek(df).collect()[0]["fields"]
    assert [f and f["kind"] for f in (fields[k] for k in "abcdefghij")] == list(cases.values())


def _frame(proto, src, dst, sport, dport, payload=b""):
    if proto == 6:
        body = struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 0x50, 0x12, 512, 0, 0) + payload
    else:
        body = struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, 64, proto, 0, bytes(src), bytes(dst))
    return b"\xaa" * 12 + b"\x08\x00" + ip + body


@pytest.mark.parametrize("order,magic", [("<", b"\xd4\xc3\xb2\xa1"), (">", b"\xa1\xb2\xc3\xd4")])
def test_pcap(spark, tmp_path, order, magic):
    v6 = b"\xaa" * 12 + b"\x86\xdd" + struct.pack(">IHBB16s16s", 6 << 28, 8, 17, 64, b"\0" * 15 + b"\1", b"\0" * 15 + b"\2") + struct.pack(">HHHH", 1, 2, 8, 0)
    frames = [_frame(6, (10, 0, 0, 1), (10, 0, 0, 2), 5, 80, b"x" * 2000), b"junk", v6, _frame(17, (1, 1, 1, 1), (2, 2, 2, 2), 7, 53, b"q")]
    data = magic + struct.pack(order + "HHiIII", 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(frames):
        data += struct.pack(order + "IIII", 100 + i, 250, len(f), len(f)) + f
    (tmp_path / "a.pcap").write_bytes(data + b"\0" * 7)
    got = sorted(tuple(r) for r in pcap.read_pcap(spark, str(tmp_path / "a.pcap")).select(
        "packet_number", "ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", F.octet_length("payload"), "tcp_flags", "window", "payload_len").collect())
    assert got == [
        (1, 100_000_250, "10.0.0.1", "10.0.0.2", 5, 80, 6, 1024, 0x12, 512, 2000),
        (3, 102_000_250, "::1", "::2", 1, 2, 17, 0, None, None, 0),
        (4, 103_000_250, "1.1.1.1", "2.2.2.2", 7, 53, 17, 1, None, None, 1),
    ]


def test_cut_datagrams(spark):
    rows = [(b"",), (b"\0\5",), (b"\0\5\0\2" + b"\0" * 30,), (b"\0\x09" + b"\0" * 10,), (b"\0\x09" + b"\0" * 22 + b"\xff\xff",)]
    df = spark.createDataFrame(rows, "datagram binary").withColumn("exporter", F.lit("e"))
    assert netflow.decode_netflow_v5(df).count() == 0
    assert netflow.netflow_v9_templates(df).count() == 0
    assert netflow.decode_netflow_v9(df).count() == 0
    assert netflow.decode_ipfix(df).count() == 0
    assert netflow.decode_sflow(df).count() == 0


def test_templates_change_fields_repeat_and_sections_are_cut(spark):
    """Two templates in one set, one replaced later, a repeated field, a field of three bytes, a cut data set."""

    def v9(secs, *sets):
        head = struct.pack(">HHIIIHH", 9, len(sets), 5000, secs, 0, 3, 4)
        return head + b"".join(struct.pack(">HH", i, len(b) + 4) + b for i, b in sets)

    def template(tid, *fields):
        return struct.pack(">HH", tid, len(fields)) + b"".join(struct.pack(">HH", *f) for f in fields)

    one = template(256, (7, 2), (7, 2), (8, 4), (2, 3))
    two = template(300, (11, 1), (22, 4))
    rows = [
        (0, v9(100, (0, one + two), (256, bytes([0, 1, 0, 9, 10, 0, 0, 1, 0, 0, 7]) * 2 + b"xx"), (300, b"\x05" + struct.pack(">I", 4000)))),
        (1, v9(200, (0, template(256, (11, 2))), (256, b"\0\x50\0\x51"))),
        (2, v9(300, (256, b"\1\0"))[:-1]),
        (3, v9(400, (256, b"\1\1"))),
        (4, None),
    ]
    df = spark.createDataFrame(rows, "n int, datagram binary").withColumn("exporter", F.lit("e"))
    got = netflow.decode_netflow_v9(df).select("n", "src_port", "dst_port", "src_ip", "packets", "flow_start", "flow_end", "engine_type", "engine_id")
    assert sorted(tuple(r) for r in got.collect()) == [
        (0, 0, 5, "0.0.0.0", 0, 99.0, 100.0, 3, 4),
        (0, 9, 0, "10.0.0.1", 0, 100.0, 100.0, 3, 4),
        (0, 9, 0, "10.0.0.1", 0, 100.0, 100.0, 3, 4),
        (1, 0, 80, "0.0.0.0", 0, 200.0, 200.0, 3, 4),
        (1, 0, 81, "0.0.0.0", 0, 200.0, 200.0, 3, 4),
        (3, 0, 257, "0.0.0.0", 0, 400.0, 400.0, 3, 4),
    ]
    assert netflow.netflow_v9_templates(df).count() == 3


def test_flow_exports_are_walked_in_batches(spark, sf_dir):
    """Array expressions that step through every datagram took most of the time; no such walk is left in the plans."""
    from flowspark.plans import q_sources

    for name in ("decode_netflow_v9", "decode_ipfix", "netflow_templates", "decode_sflow"):
        plan = getattr(q_sources, name)(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "aggregate(sequence" not in plan


def test_queries_keep_generated_methods_small(spark, sf_dir):
    """Stages with larger methods were interpreted by the JVM, in sessions made elsewhere too."""
    from flowspark.plans import q_sources

    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    q_sources.zeek_records(spark, sf_dir)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_zeek_field_is_that_of_all_fields(spark):
    raw = {"ts": "1,5", "a": "-", "b": "T", "c": "1,2", "d": "0.5", "e": "7", "f": "x"}
    df = zeek.normalize_zeek(spark.createDataFrame([(raw,)], "fields_raw map<string,string>"))
    row = df.select("fields", *[zeek.zeek_field(n).alias(f"_{n}") for n in (*raw, "none")]).collect()[0]
    assert all(row[f"_{n}"] == row["fields"][n] for n in raw) and row["_none"] is None


def test_window_rows_hold_what_the_windows_hold(spark):
    from collections import Counter

    rng = random.Random(5)
    rows = [(f"f{rng.randrange(3)}", float(t), t, [float(t)] * (2 if rng.random() < 0.1 else 1)) for t in range(80)]
    df = spark.createDataFrame(rows, "flow_key string, timestamp double, id int, vec array<double>")
    for length, block in ((1, 1), (3, 4), (5, 5), (4, 100)):
        want = Counter(v[0] for w in Q.sliding_sequences(df, length, width=1, block=block).collect() for v in w["seq"])
        held = Q.window_rows(df, length, width=1, block=block)
        assert {r["vec"][0]: r["weight"] for r in held.collect()} == dict(want)
        fit = TR.fit_normalization(held.withColumn("seq", F.array("vec")), width=1, weight="weight").collect()[0]
        every = list(want.elements())
        mean = sum(every) / len(every)
        assert fit["means"] == [pytest.approx(mean)]
        assert fit["scales"] == [pytest.approx((sum((v - mean) ** 2 for v in every) / len(every)) ** 0.5)]
    gaps = spark.createDataFrame([([[1.0, None], [3.0, 5.0], [7.0]],), (None,)], "seq array<array<double>>")
    fit = TR.fit_normalization(gaps, "variance", width=3).collect()[0]
    assert fit["means"] == [pytest.approx(11 / 3), 5.0, 0.0] and fit["scales"] == [pytest.approx(56 / 9), 1.0, 1.0]


def test_split_sequences_gathers_no_vectors(spark):
    df = spark.createDataFrame([("f", 1.0, 1, [1.0])], "flow_key string, timestamp double, id int, vec array<double>")
    light = Q.sliding_sequences(df, 2, width=1).select("flow_key", "first_ts", "start_pos")
    assert "collect_list" not in light._jdf.queryExecution().optimizedPlan().toString()


def test_rules(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "b.yml").write_text("id: r1\ntitle: T\ndetection:\n  selection: {a: 1}\n")
    (tmp_path / "a.yml").write_text("id: r0\ndetection: none\nlevel: low\n")
    (tmp_path / "c.yml").write_text("title: no detection\n")
    (tmp_path / "d.yml").write_text("{broken")
    got = {r["id"]: (r["title"], r["level"], r["has_selection"]) for r in tables.read_rules(spark, str(tmp_path)).collect()}
    assert got == {"r0": (None, "low", False), "r1": ("T", "medium", True)}
    flows = spark.createDataFrame([(1, 200, 0.5, 1, 1), (2, 1, 5.0, 2000, 10), (3, 1, 5.0, 2000, 9000)], "n int, syn_flag_count int, duration double, fwd_packets int, fwd_bytes int")
    hit = {r["n"]: r["rule_id"] for r in D.first_rule(flows, tables.read_rules(spark, str(tmp_path))).collect()}
    assert hit == {1: "r1", 2: "r1", 3: None}


def test_json_sources(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"timestamp": 1.000001, "src_ip": "a", "dst_ip": "b", "src_port": 1, "dst_port": 2, "protocol": 6, "length": 9}\n')
    assert tables.read_packets(spark, str(tmp_path / "p.json")).collect()[0]["ts_us"] == 1_000_001
    (tmp_path / "f.json").write_text('[{"flow_key": "k", "features": {"duration": 1}, "label": 1}, {"flow_key": "j"}]')
    assert tables.read_flows(spark, str(tmp_path / "f.json")).count() == 2
    for name in ("x", "y"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "d.json").write_text('{"alert_type": "t", "flow_key": "k"}\n')
    assert tables.read_detections(spark, [str(tmp_path / "x"), str(tmp_path / "y")]).count() == 2


def test_sinks(spark, sf_dir, tmp_path):
    alerts = prepare_alerts(V.detections(spark, sf_dir))
    K.write_routed(alerts, str(tmp_path / "routed"))
    back = spark.read.json(str(tmp_path / "routed")).groupBy("topic").count().collect()
    want = alerts.groupBy("output_topic").count().collect()
    assert sorted(map(tuple, back)) == sorted(map(tuple, want))
    K.write_ecs_batch(str(tmp_path / "ecs"))(alerts, 0)
    K.write_ecs_batch(str(tmp_path / "ecs"))(alerts, 0)
    docs = spark.read.parquet(str(tmp_path / "ecs"))
    assert docs.count() == alerts.count()
    plan = docs.filter("severity = 'error'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(severity" in plan
    K.write_topic(alerts.select("alert_id", "severity"), str(tmp_path / "topic"))
    assert spark.read.json(str(tmp_path / "topic")).columns == ["alert_id", "severity"]
    K.save_model_tables(spark, str(tmp_path / "m"), 0.5, [1, 2], [3, 4], "v1")
    assert spark.read.json(str(tmp_path / "m/threshold")).collect()[0]["threshold"] == 0.5


def tree(spark, rows):
    return spark.createDataFrame(rows, "tree int, node int, split_idx int, split_val double, lhs int, rhs int, size int")


def test_forest_score(spark):
    df = spark.createDataFrame([([0.0, 1.0],), ([9.0, 1.0],)], "vec array<double>")
    c = D.path_factor(256)
    stump = tree(spark, [(0, 0, 0, 5.0, 1, 2, None), (0, 1, None, None, None, None, 1), (0, 2, None, None, None, None, 3)])
    got = [r[0] for r in D.iforest_score(df, stump).select("anomaly_score").collect()]
    assert got == pytest.approx([2 ** (-1.5 / c), 2 ** (-2.5 / c)])
    leaf = D.iforest_score(df, tree(spark, [(0, 0, None, None, None, None, 1)])).collect()[0]["anomaly_score"]
    assert leaf == pytest.approx(2 ** (-0.5 / c))
    beyond = D.iforest_score(df, tree(spark, [(0, 0, 7, 1.0, 1, 2, None)])).collect()[0]["anomaly_score"]
    assert beyond == pytest.approx(1.0)
    broken = D.iforest_score(df, tree(spark, [(0, 0, 0, 5.0, None, 1, None), (0, 1, None, None, None, None, 1)])).collect()
    assert broken[0]["anomaly_score"] is None and broken[1]["anomaly_score"] == pytest.approx(2 ** (-1.5 / c))
    assert D.iforest_score(df, None).collect()[0]["anomaly_score"] == 0.5


def test_forest_fit_finds_the_outlier(spark):
    df = spark.range(600).select("id", F.when(F.col("id") == 7, F.array(F.lit(50.0), F.lit(-50.0))).otherwise(
        F.array((F.col("id") % 13).cast("double"), (F.col("id") % 7).cast("double"))).alias("vec"))
    trees = T.iforest_fit(df, "id", n_trees=20, max_samples=128).cache()
    again = T.iforest_fit(df.repartition(3), "id", n_trees=20, max_samples=128)
    key = lambda d: sorted(map(str, d.collect()))
    assert key(trees) == key(again) and trees.select("tree").distinct().count() == 20
    scored = D.iforest_score(df, trees, 128).orderBy(F.desc("anomaly_score")).limit(1).collect()[0]
    assert scored["id"] == 7


@pytest.mark.parametrize("width", [60.0, 8.0])
def test_sliding_windows(spark, monkeypatch, width):
    monkeypatch.setattr(Q, "WIDTH_S", width)

    def windows(rows, length, stride=1):
        df = spark.createDataFrame([(k, float(t), i, [float(x) for x in v]) for i, (k, t, v) in enumerate(rows)], "flow_key string, timestamp double, id int, vec array<double>")
        out = Q.sliding_sequences(df, length, stride, width=1, block=4).collect()
        return sorted((r["flow_key"], r["first_ts"], [v[0] for v in r["seq"]]) for r in out)

    assert len(windows([(k, t, [t]) for k in "ab" for t in range(5)], 3)) == 6
    assert windows([("a", t, [t]) for t in (3, 1, 2)], 3) == [("a", 1.0, [1.0, 2.0, 3.0])]
    assert windows([("a", t, [t]) for t in (1, 2)], 3) == []
    assert len(windows([("a", 0, [1, 2]), *[("a", t, [t]) for t in (1, 2, 3)]], 3)) == 1
    assert len(windows([("a", t, [t]) for t in range(6)], 3, 2)) == 2
    assert windows([("", t, [t]) for t in range(6)], 3) == []
    long = windows([("a", t, [t]) for t in range(40)], 5)
    assert [w[2] for w in long] == [[float(s + i) for i in range(5)] for s in range(36)]


@pytest.mark.parametrize("lines", ["aws_lines", "gcp_lines", "azure_docs"])
def test_lines_of_one_row_group_are_parsed_by_many_tasks(spark, sf_dir, lines):
    from flowspark.plans import q_sources

    df = getattr(q_sources, lines)(spark, sf_dir)
    assert spark.read.parquet(f"{sf_dir}/lineitem.parquet").rdd.getNumPartitions() == 1
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_bulk_packets_of_one_row_group_are_made_by_many_tasks(spark, sf_dir):
    from flowspark.plans import views

    assert views.bulk_packets(spark, sf_dir).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
