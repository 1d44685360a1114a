"""A stream over split files gives what the batch operator gives."""

import pytest
from pyspark.sql import functions as F

from flowspark.functions import vectors as X
from flowspark.operators import alerts as O
from flowspark.operators import flows
from flowspark.operators import monitor as M
from flowspark.operators import sequences as Q
from flowspark.plans import q_detect
from flowspark.plans import views as V
from flowspark.sources import netflow
from flowspark.streaming import stateful as S
from flowspark.streaming import stateless as L


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    S.use_rocksdb(spark)


def as_stream(spark, df, folder, order):
    """Write in time order to three files and read them one per micro-batch."""
    ranked = df.orderBy(order).collect()
    step = max(1, len(ranked) // 3 + 1)
    for i in range(0, len(ranked), step):
        part = spark.createDataFrame(ranked[i : i + step], df.schema).coalesce(1)
        part.write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return stream.sparkSession.table(name)


def rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_flow_sessions(spark, sf_dir, tmp_path):
    packets = V.packets(spark, sf_dir)
    last = packets.agg(F.max("ts_us")).collect()[0][0]
    flush = packets.limit(1).withColumns({"ts_us": F.lit(last + 10**12), "src_ip": F.lit("flush")})
    src = as_stream(spark, packets.unionByName(flush), tmp_path / "in", "ts_us")
    out = run(L.stream_flow_sessions(L.with_event_time(src, "1 minute"), 86_400), "sess")
    cols = ["flow_id", "start_time", "duration", "packets_total", "bytes_total", "packets_fwd", "bytes_rev", "max_pkt_size"]
    want = rows(flows.flow_sessions(packets, 86_400), cols)
    assert rows(out.filter(~F.contains("flow_id", F.lit("flush"))), cols) == want


def test_dedup(spark, sf_dir, tmp_path):
    alerts = O.prepare_alerts(V.detections(spark, sf_dir)).select("dedup_key", "ts_us", "event_id", "severity")
    src = as_stream(spark, alerts, tmp_path / "in", "ts_us")
    out = run(S.stream_dedup(L.with_event_time(src), 86_400, tie="event_id"), "dedup")
    assert rows(out, ["event_id", "dedup_key"]) == rows(O.dedup_alerts(alerts, 86_400, tie="event_id"), ["event_id", "dedup_key"])


def test_correlation_sessions(spark, sf_dir, tmp_path):
    alerts = O.prepare_alerts(V.detections(spark, sf_dir)).select("group_id", "flow_key", "src_ip", "dst_ip", "ts_us", "event_id")
    src = as_stream(spark, alerts, tmp_path / "in", "ts_us")
    out = run(S.stream_correlation_sessions(L.with_event_time(src), 172_800, tie="event_id"), "corr")
    want = O.correlation_sessions(alerts, 172_800, tie="event_id")
    assert rows(out, ["event_id", "group_id", "session_us"]) == rows(want, ["event_id", "group_id", "session_us"])


def test_tumbling_sequences(spark, sf_dir, tmp_path):
    vecs = X.strict_vector(q_detect.vector_flows(spark, sf_dir)).select("flow_key", "timestamp", "vec", "event_id")
    src = as_stream(spark, vecs, tmp_path / "in", "timestamp")
    out = run(S.stream_tumbling_sequences(src, 5, tie="event_id"), "tumble")
    cols = ["flow_key", "timestamp", F.get(F.get("seq", F.lit(0)), F.lit(0)).alias("head")]
    assert rows(out, cols) == rows(Q.tumbling_sequences(vecs, 5, tie="event_id"), cols)


def test_templates(spark, tmp_path):
    spec = [(8, 4), (12, 4)]
    templates = spark.createDataFrame(
        [("a", 256, spec, 0), ("a", 256, spec[:1], 5_000_000_000), ("b", 256, spec, 0)],
        "exporter string, template_id int, spec array<struct<ftype:int,flen:int>>, seen_us bigint",
    )
    data = spark.createDataFrame(
        [("a", 256, t * 1_000_000, t) for t in (0, 10, 3600, 3601, 5000, 8601)] + [("c", 256, 5, 99)],
        "exporter string, template_id int, ts_us bigint, n int",
    )
    want = rows(netflow.asof_templates(data, templates), ["n", F.size("spec").alias("k")])
    assert want == [(0, 2), (10, 2), (3600, 2), (5000, 1)]
    tpl = as_stream(spark, templates, tmp_path / "t", "seen_us").coalesce(1)
    src = as_stream(spark, data, tmp_path / "d", "ts_us")
    templates.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "t1"))
    data.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "d1"))
    tpl = spark.readStream.schema(templates.schema).parquet(str(tmp_path / "t1"))
    src = spark.readStream.schema(data.schema).parquet(str(tmp_path / "d1"))
    out = run(S.stream_templates(src, tpl), "tpl")
    assert rows(out, ["n", F.size("spec").alias("k")]) == want


def test_rates_and_counters(spark, sf_dir, tmp_path):
    alerts = O.prepare_alerts(V.detections(spark, sf_dir)).select("severity", "is_anomaly", "src_ip", "ts_us", "inference_time_ms")
    src = as_stream(spark, alerts, tmp_path / "in", "ts_us")
    timed = alerts.withColumn("ts", F.timestamp_micros("ts_us"))
    out = run(L.stream_rates(L.with_event_time(src), ["src_ip"]), "rates", "complete")
    assert rows(out, ["window_start", "src_ip", "n"]) == rows(M.windowed_rate(timed, ["src_ip"]), ["window_start", "src_ip", "n"])
    counted = run(L.stream_counters(src), "counts", "complete")
    want = alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("total"), F.count_if("is_anomaly").alias("anomalies"))
    assert rows(counted, ["severity", "total", "anomalies"]) == rows(want, ["severity", "total", "anomalies"])
