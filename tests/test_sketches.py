"""Stored quantile sketches: merged minutes against exact ranks, several streams, odd values."""

import datetime as dt
import random

from flowspark.operators import monitor as M


def test_merged_sketches_keep_their_error(spark):
    rng, t0 = random.Random(5), dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(seconds=rng.randrange(600)), "ab"[k % 3 == 0], rng.lognormvariate(0, 2)) for k in range(30_000)]
    odd = [(t0, "a", None), (t0, "a", float("nan")), (None, "a", 1.0)]
    df = spark.createDataFrame(rows + odd, "ts timestamp, stream string, v double")
    minutes = M.quantile_sketches(df, "v", by=["stream"])
    assert minutes.count() == 20
    both = M.merge_sketches(minutes)
    got = M.sketch_quantiles(both, (0.5, 0.95)).collect()
    assert len(got) == 2 and sum(r.n for r in got) == len(rows)
    for r in got:
        first = r.window_start.minute // 5 * 300
        values = [v for t, _, v in rows if first <= (t - t0).seconds < first + 300]
        assert r.n == len(values)
        for p, x in ((0.5, r.p50), (0.95, r.p95)):
            assert abs(sum(v <= x for v in values) / len(values) - p) <= 2 * M.SKETCH_ERROR
    apart = M.merge_sketches(minutes, "1 hour", by=["stream"]).collect()
    assert {r.stream: r.n for r in apart} == {s: sum(x == s for _, x, _ in rows) for s in "ab"}


def test_small_and_empty_sketches_are_exact(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), float(k)) for k in range(1, 12)], "ts timestamp, v double")
    r = M.sketch_quantiles(M.merge_sketches(M.quantile_sketches(df, "v"))).first()
    assert (r.n, r.p50) == (11, 6.0)
    assert M.merge_sketches(M.quantile_sketches(df.limit(0), "v")).count() == 0
