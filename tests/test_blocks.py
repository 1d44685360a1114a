"""Windows kept in blocks: the same windows, splits, means and components as windows written out; vectors are built once."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.operators import training as T
from flowspark.operators.ordinal import split_ordered
from flowspark.operators.sequences import sliding_sequences, window_blocks
from flowspark.plans import q_alerts as QA
from flowspark.plans import q_detect as Q
from flowspark.schemas import FEATURES
from flowspark.session import stored

WIDTH = len(FEATURES)


@pytest.fixture(scope="module")
def flows(spark):
    rng = np.random.default_rng(5)
    rows = []
    for key, n in (("a", 75), ("b", 3), ("c", 40), ("d", 33)):
        for t in range(n):
            width = WIDTH if (key, t) != ("c", 17) else 3
            rows.append((key, float(t // 2), t, rng.normal(size=width).tolist()))
    return spark.createDataFrame(rows, "flow_key string, timestamp double, id long, vec array<double>").repartition(5)


def _plain(flows, length):
    windows = sliding_sequences(flows, length).select("flow_key", "first_ts", "start_pos", "seq")
    return split_ordered(windows, ties=["start_pos"])


@pytest.mark.parametrize("block", [4, 16, 1000])
def test_blocks_hold_the_same_windows(spark, flows, block):
    plain = _plain(flows, 4).cache()
    blocks = window_blocks(flows, 4, block=block)
    assert T.window_count(blocks) == plain.count()
    norm = T.fit_normalization(plain.filter("split = 'train'")).collect()[0]
    means, scales = T.normalization_of(blocks, 4, WIDTH)
    assert np.allclose(means, norm["means"]) and np.allclose(scales, norm["scales"])
    got = T.window_errors(blocks, 4, [0.0] * WIDTH, [1.0] * WIDTH, lambda x: x.sum(axis=(1, 2))).collect()
    want = plain.select("split", F.aggregate(F.flatten("seq"), F.lit(0.0), lambda s, v: s + v).alias("e")).collect()
    assert sorted((r[0], round(r[1], 6)) for r in got) == sorted((r[0], round(r[1], 6)) for r in want)


def test_components_of_blocks(flows):
    plain = _plain(flows, 4).toPandas()
    params, losses = T.sequence_fit(flows, 4, k=8)
    x = {s: np.stack([np.concatenate(w) for w in plain.loc[plain["split"] == s, "seq"]]) for s in ("train", "val", "test")}
    mean, scale = np.tile(params.means, 4), np.tile(params.scales, 4)
    z = {s: (v - mean) / scale for s, v in x.items()}
    basis = np.linalg.svd(z["train"] - z["train"].mean(axis=0))[2][:8].T
    error = {s: ((v - v @ basis @ basis.T) ** 2).mean(axis=1) for s, v in z.items()}
    assert {r["split"]: r["loss"] for r in losses.collect()} == pytest.approx({s: e.mean() for s, e in error.items()})
    ordered = np.sort(error["val"])
    assert params.threshold == pytest.approx(ordered[min(int(len(ordered) * 0.95), len(ordered) - 1)])


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_join_scores_reads_stored_vectors(spark, sf_dir):
    # the 51 texts of a row were made once for the summaries of its chunk and once for its window
    assert "map_from_arrays" not in _plan(Q.join_scores(spark, sf_dir))


def _reads(df, name):
    return any(name in f for f in df.inputFiles())


def test_group_scores_reads_stored_ranks(spark, sf_dir):
    # the alerts were prepared, hashed and ranked again for every summary
    assert not _reads(QA.group_scores(spark, sf_dir), "events.parquet")


def test_fast_detect_reads_stored_flows(spark, sf_dir):
    # sessions were made again for the count, the samples and the scores
    assert not _reads(Q.fast_detect(spark, sf_dir), "events.parquet")


def test_stored_tables_leave_no_shuffle_files(spark):
    # they stayed until the driver collected its garbage
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def files():
        return {f for d in folders for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}

    before = files()
    stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().write.format("noop").mode("overwrite").save()
    assert files() - before
