"""Chunks of any width give the same results as one plain window."""

import random

import pytest
from pyspark.sql import functions as F

from flowspark.operators import alerts as O
from flowspark.operators import flows
from flowspark.operators.ordered import Ordered, in_runs, runs
from flowspark.operators.ordinal import global_ordinal, global_prefix, group_quantiles, percentile_threshold, split_ordered
from flowspark.plans import views as V


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows, many of them at one instant."""
    rnd = random.Random(7)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else f"k{i % 50}"
        ts = 1_000 if i % 9 == 0 else rnd.randrange(100_000)
        rows.append((key, ts, i, rnd.randrange(10)))
    return spark.createDataFrame(rows, "key string, ts_us long, n long, v long").repartition(5).cache()


def both_ways(df, step):
    plain = step(Ordered(df, ["key"], ["ts_us", "n"], width=10**9)).result()
    order = sorted(plain.columns)
    rows = [sorted(map(tuple, d.select(*order).collect()), key=str) for d in (plain, step(Ordered(df, ["key"], ["ts_us", "n"], width=900)).result())]
    assert rows[0] == rows[1]
    assert len(rows[0]) == df.count()
    return [dict(zip(order, r)) for r in rows[0]]


def in_order(rows):
    """Rows of each key, sorted."""
    by = {}
    for r in sorted(rows, key=lambda r: (r["ts_us"], r["n"])):
        by.setdefault(r["key"], []).append(r)
    return by.values()


def test_prev(skewed):
    rows = both_ways(skewed, lambda o: o.prev(p="v", q=F.col("ts_us"), z=F.when(F.col("v") > 5, F.col("v"))))
    for own in in_order(rows):
        assert own[0]["p"] is None and own[0]["q"] is None
        for a, b in zip(own, own[1:]):
            assert (b["p"], b["q"], b["z"]) == (a["v"], a["ts_us"], a["v"] if a["v"] > 5 else None)


@pytest.mark.parametrize("gap,width", [(700, None), (700, 50), (0, None), (None, None), (10**9, 5_000)])
def test_runs(spark, skewed, gap, width):
    nulls = skewed.limit(30).withColumn("key", F.lit(None).cast("string"))
    df = skewed.unionByName(nulls)
    got = [r.asDict() for r in in_runs(df, ["key"], "ts_us", gap, width, keep=["is_new"]).collect()]
    assert len(got) == 930
    for own in in_order(got):
        start = last = None
        for r in own:
            if last is None or (gap is not None and r["ts_us"] - last > gap):
                start = r["ts_us"]
            last = r["ts_us"]
            assert r["run_at"] == start
    sizes = runs(df, ["key"], "ts_us", gap, width).agg(F.sum("n")).first()[0]
    assert sizes == 930


def test_plans_stay_small(spark, sf_dir):
    """No job runs while a plan is built, and it doesn't grow with the data."""
    alerts, packets = O.prepare_alerts(V.detections(spark, sf_dir)), V.packets(spark, sf_dir)  # footers are read by jobs
    spark.sparkContext.setJobGroup("plans", "building")
    try:
        scored = O.group_scores(alerts, tie="event_id")
        flows.flow_vector51(packets)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plans")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(scored._jdf.queryExecution().optimizedPlan().numberedTreeString().strip().split("\n")) < 300


def test_running(skewed):
    rows = both_ways(skewed, lambda o: o.running(s=("sum", "v"), m=("max", F.when(F.col("v") > 6, F.col("ts_us")))))


    for own in in_order(rows):
        total, top = 0, None
        for r in own:
            total += r["v"]
            top = max(filter(None, (top, r["ts_us"] if r["v"] > 6 else None)), default=None)
            assert (r["s"], r["m"]) == (total, top)


def test_running_exclusive(skewed):
    both_ways(skewed, lambda o: o.running(inclusive=False, s=("sum", "v"), m=("max", "v")))


def test_number(skewed):
    for own in in_order(both_ways(skewed, lambda o: o.number("pos"))):
        assert [r["pos"] for r in own] == list(range(len(own)))


def test_sessions_of_a_hot_flow(spark, sf_dir, monkeypatch):
    hot = V.packets(spark, sf_dir).withColumns(
        {
            "src_ip": F.when(F.col("packet_number") % 3 == 0, "10.9.9.9").otherwise(F.col("src_ip")),
            "dst_ip": F.when(F.col("packet_number") % 3 == 0, "192.168.9.9").otherwise(F.col("dst_ip")),
            "src_port": F.when(F.col("packet_number") % 3 == 0, 1).otherwise(F.col("src_port")),
            "dst_port": F.when(F.col("packet_number") % 3 == 0, 2).otherwise(F.col("dst_port")),
            "protocol": F.when(F.col("packet_number") % 3 == 0, 6).otherwise(F.col("protocol")),
        }
    )
    rounded = []
    for width in (10**12, 200_000_000):  # as wide as the idle gap lets it be, and narrow
        monkeypatch.setattr(flows, "WIDTH_US", width)
        df = flows.flow_vector51(hot, 86_400, idle_gap_s=40_000).drop("features")
        rounded.append(sorted(str([round(x, 5) if isinstance(x, float) else x for x in r]) for r in df.collect()))
    assert rounded[0] == rounded[1]


def test_group_scores_of_a_hot_group(spark, sf_dir, monkeypatch):
    alerts = O.prepare_alerts(V.detections(spark, sf_dir)).withColumns(
        {"flow_key": F.when(F.col("event_id") % 3 == 0, "hot").otherwise(F.col("flow_key")),
         "src_ip": F.lit("a"), "dst_ip": F.lit("b")}
    )
    cols = ["event_id", "group_rank", F.round("correlation_score", 8).alias("s")]
    plain = sorted(map(tuple, O.group_scores(alerts, 86_400, tie="event_id").select(*cols).collect()))
    monkeypatch.setattr(O, "WIDTH_US", 120_000_000)
    split = sorted(map(tuple, O.group_scores(alerts, 86_400, tie="event_id").select(*cols).collect()))
    assert plain == split


def test_group_scores_of_large_and_small_groups(spark, sf_dir, monkeypatch):
    alerts = O.prepare_alerts(V.detections(spark, sf_dir)).withColumns(
        {"flow_key": F.concat(F.lit("f"), F.floor(F.sqrt(F.col("event_id")))), "src_ip": F.lit("a"), "dst_ip": F.lit("b")}
    ).withColumn("ts_us", F.when(F.col("event_id") % 50 != 0, F.col("ts_us")))
    cols = ["event_id", "session_us", "group_rank", F.round("correlation_score", 8).alias("s")]
    found = []
    for part in (25_000, 30, 0):  # all groups whole, some of them, none
        monkeypatch.setattr(O, "PART", part)
        found.append(sorted(map(str, O.group_scores(alerts, 86_400, tie="event_id").select(*cols).collect())))
    assert found[0] == found[1] == found[2]


def test_ordinals(spark, skewed):
    got = global_ordinal(skewed, ["ts_us", "n"]).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in got] == list(range(900))
    assert [(r["ts_us"], r["n"]) for r in got] == sorted((r["ts_us"], r["n"]) for r in got)
    assert {r["ordinal_n"] for r in got} == {900}


def test_ordinals_in_groups(skewed):
    got = global_ordinal(skewed, ["ts_us", "n"], group=["key"]).collect()
    by = {}
    for r in got:
        by.setdefault(r["key"], []).append((r["ordinal"], r["ts_us"], r["n"], r["ordinal_n"]))
    for rows in by.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(len(rows)))
        assert [r[1:3] for r in rows] == sorted(r[1:3] for r in rows)
        assert {r[3] for r in rows} == {len(rows)}


def test_global_prefix(skewed):
    got = global_prefix(skewed, ["ts_us", "n"], s=F.col("v")).orderBy("ts_us", "n").collect()
    total = 0
    for r in got:
        total += r["v"]
        assert r["s"] == total


def test_group_quantiles(spark):
    df = spark.createDataFrame([(g, float(v)) for g in "ab" for v in range(11)], "g string, v double")
    got = {r["g"]: (r["p50"], r["p95"]) for r in group_quantiles(df, "v", [0.5, 0.95], ["g"]).collect()}
    assert got == {"a": (5.0, 9.5), "b": (5.0, 9.5)}


@pytest.mark.parametrize("values,p,want", [(range(100), 95, 95.0), (range(100), 50, 50.0), ([1, 2], 100, 2.0), ([], 95, 0.0)])
def test_percentile_threshold(spark, values, p, want):
    df = spark.createDataFrame([(float(v),) for v in values], "e double")
    assert percentile_threshold(df, "e", p).collect()[0][0] == want


def test_split_ordered(spark):
    df = spark.createDataFrame([(f"k{i:03d}", float(i)) for i in range(100)], "flow_key string, first_ts double")
    rows = split_ordered(df).collect()
    sizes = {s: sum(r["split"] == s for r in rows) for s in ("train", "val", "test")}
    want = {"train": sum(i / 99 < 0.8 for i in range(100)), "val": sum(0.8 <= i / 99 < 0.9 for i in range(100))}
    assert sizes["train"] == want["train"] and sum(sizes.values()) == 100
    assert split_ordered(df.limit(0)).count() == 0
