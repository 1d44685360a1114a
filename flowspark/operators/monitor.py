"""Rates, quantiles, top sources, counters, evaluation and drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowspark.operators.ordinal import global_prefix, group_quantiles, group_values_at


def _seconds_of(window: Column) -> Column:
    return F.unix_seconds(window["end"]) - F.unix_seconds(window["start"])


def windowed_rate(df: DataFrame, by: Sequence[str] = (), window: str = "5 minutes", slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Events per second in each time window, overall or per value of ``by``."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    counts = df.groupBy(w.alias("window"), *by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        F.col("window.start").alias("window_start"), *by, "n", (F.col("n") / _seconds_of(F.col("window"))).alias("rate")
    )


def windowed_quantiles(df: DataFrame, col: str, probs: Sequence[float] = (0.5, 0.95, 0.99), window: str = "5 minutes", exact: bool = False, ts: str = "ts") -> DataFrame:
    """Quantiles per tumbling window: approximate (streams) or exact and interpolated."""
    timed = df.select(F.window(ts, window).getField("start").alias("window_start"), F.col(col).alias("_v"))
    if exact:
        return group_quantiles(timed, "_v", probs, ["window_start"])
    return timed.groupBy("window_start").agg(
        *[F.percentile_approx("_v", p, 10_000).alias(f"p{round(p * 100)}") for p in probs]
    )


#: Entries per level of a quantile sketch, and the rank error that it keeps to (with 99 % confidence for one quantile).
SKETCH_K = 1000
SKETCH_ERROR = 0.005


def quantile_sketches(df: DataFrame, col: str, window: str = "1 minute", by: Sequence[str] = (), ts: str = "ts", k: int = SKETCH_K) -> DataFrame:
    """(window_start, by, n, sketch): a KLL sketch of the values of each window, to be stored and merged later.

    Null and NaN values and rows without a time don't count; windows without values give no row.
    """
    value = F.col(col).cast("double")
    timed = df.filter(value.isNotNull() & ~F.isnan(value)).select(F.window(ts, window)["start"].alias("window_start"), *by, value.alias("_v"))
    return timed.groupBy("window_start", *by).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("_v", k).alias("sketch"))


def merge_sketches(sketches: DataFrame, window: str = "5 minutes", by: Sequence[str] = (), k: int = SKETCH_K) -> DataFrame:
    """Sketches of longer windows from those of shorter ones, and of several streams or keys (``by`` names those kept apart).

    ``window`` should be a multiple of the windows merged; a merge reads sketches of a fixed size, never values.
    """
    start = F.window("window_start", window)["start"]
    timed = sketches.select(start.alias("_start"), *by, "n", "sketch")
    return timed.groupBy(F.col("_start").alias("window_start"), *by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, probs: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Quantiles of every sketch, as p50, p95 and so on in place of ``sketch``."""
    got = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(f"p{round(p * 100)}") for p in probs]
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], *got)


def top_sources(alerts: DataFrame, k: int = 10, window: str = "5 minutes", ts: str = "ts", source: str = "src_ip") -> DataFrame:
    """The ``k`` busiest sources of each window; ties go to the smaller address."""
    rates = windowed_rate(alerts, [source], window, ts=ts)
    rank = F.row_number().over(Window.partitionBy("window_start").orderBy(F.desc("n"), F.asc(source)))
    return rates.withColumn("rank", rank).filter(F.col("rank") <= k)


def stage_counters(**stages: DataFrame) -> DataFrame:
    """``stage, n`` for named stages of a flow of records."""
    out = None
    for name, df in stages.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("at least one stage is needed")
    return out


def evaluate(df: DataFrame, score: str, label: str, threshold: float = 0.5, at_tpr: float = 0.95) -> DataFrame:
    """One row: AUC (ties count half), precision, recall, F1 at a threshold, FPR at a given TPR.

    Rows are first counted per distinct score, then accumulated from the highest down. Where a
    class is missing, AUC and the false positive rate are null.
    """
    y = F.col(label).cast("int")
    per_score = df.groupBy(F.col(score).alias("s")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")
    )
    curve = global_prefix(per_score, [F.desc("s")], tp=F.col("pos"), fp=F.col("neg"))
    totals = per_score.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    p, n = totals.select("P").scalar(), totals.select("N").scalar()
    above = F.col("s") > threshold
    # a positive beats every negative still below its score and half of those at it
    wins = F.col("pos") * (n - F.col("fp") + F.col("neg") / 2)
    sums = curve.agg(
        F.try_divide(F.sum(wins), p * n).alias("auc"),
        F.coalesce(F.sum(F.when(above, F.col("pos"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(above, F.col("neg"))), F.lit(0)).alias("fp"),
        F.min(F.when(F.try_divide(F.col("tp"), p) >= at_tpr, F.try_divide(F.col("fp"), n))).alias("fpr_at_tpr"),
        F.sum("pos").alias("P"),
    )
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    recall = F.when(F.col("P") > 0, F.col("tp") / F.col("P")).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return sums.select("auc", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "fpr_at_tpr")


def psi_drift(reference: DataFrame, current: DataFrame, cols: Sequence[str], bins: int = 10, limit: float = 0.25, floor: float = 1e-6) -> DataFrame:
    """``feature, psi, drifted``: population stability over the reference's quantile bins.

    Edges are the sorted reference values at ``int(n*k/bins)``. Empty shares count as ``floor``.
    """

    def long(df: DataFrame) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols])
        return df.select(F.inline(pairs)).filter("v is not null")

    ref, cur = long(reference), long(current)

    def marks(n: Column) -> Column:
        return F.array(*[F.least(F.floor(n * k / F.lit(bins)).cast("long"), n - 1) for k in range(1, bins)])

    # one row per feature with at most bins - 1 numbers
    edges = group_values_at(ref, "v", ["feature"], marks, "edges")

    def shares(df: DataFrame, name: str) -> DataFrame:
        binned = df.join(F.broadcast(edges), "feature").withColumn(
            "bin", F.size(F.filter("edges", lambda e: e <= F.col("v")))
        )
        counts = binned.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("c"))
        whole = Window.partitionBy("feature")  # at most ``bins`` rows per feature
        return counts.select("feature", "bin", (F.col("c") / F.sum("c").over(whole)).alias(name))

    both = shares(ref, "r").join(shares(cur, "c"), ["feature", "bin"], "full_outer")
    r, c = (F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(floor)) for x in ("r", "c"))
    psi = F.sum((c - r) * F.ln(c / r))
    return both.groupBy("feature").agg(psi.alias("psi")).withColumn("drifted", F.col("psi") > limit)


def auc_decay(monthly: DataFrame, month: str = "month", auc: str = "auc", floor: float = 0.85, decay: float = 0.05) -> DataFrame:
    """Add the relative loss against the month before and whether it calls for retraining.

    One row per month, so the single ordered window stays tiny.
    """
    before = F.lag(auc).over(Window.partitionBy(F.lit(0)).orderBy(month))
    loss = (before - F.col(auc)) / before
    return monthly.withColumns(
        {"decay": loss, "retrain": (F.col(auc) < floor) | F.coalesce(loss > decay, F.lit(False))}
    )
