"""Operators that stream with built-in state: sessions, time windows, counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions.keys import CANONICAL, canonical_flow, flow_id, is_forward
from flowspark.operators import monitor as M

MICRO = 1_000_000


def with_event_time(df: DataFrame, delay: str = "10 minutes", ts_us: str = "ts_us") -> DataFrame:
    """Add ``ts`` and its watermark; rows later than the delay are dropped by the stateful step."""
    return df.withColumn("ts", F.timestamp_micros(ts_us)).withWatermark("ts", delay)


def stream_flow_sessions(packets: DataFrame, timeout_s: int = 300) -> DataFrame:
    """Volume features of flows that end after more than ``timeout_s`` idle.

    ``packets`` carries a watermarked ``ts``. A session window closes at last + timeout, so a
    gap of exactly the timeout still merges, as in the batch operator.
    """
    df = canonical_flow(packets).withColumn("_fwd", is_forward())
    fwd, length = F.col("_fwd"), F.col("length").cast("long")

    def total(cond):
        return F.sum(F.when(cond, length).otherwise(0))

    agg = df.groupBy(F.session_window("ts", f"{timeout_s} seconds").alias("w"), *CANONICAL).agg(
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        F.count_if(fwd).alias("packets_fwd"),
        F.count_if(~fwd).alias("packets_rev"),
        total(fwd).alias("bytes_fwd"),
        total(~fwd).alias("bytes_rev"),
        F.min("length").alias("min_pkt_size"),
        F.max("length").alias("max_pkt_size"),
    )
    duration = F.greatest((F.col("last_us") - F.col("first_us")) / F.lit(1e6), F.lit(0.001))
    packets_total, bytes_total = F.col("packets_fwd") + F.col("packets_rev"), F.col("bytes_fwd") + F.col("bytes_rev")
    return agg.select(
        flow_id().alias("flow_id"),
        (F.col("first_us") / F.lit(1e6)).alias("start_time"),
        duration.alias("duration"),
        packets_total.alias("packets_total"),
        bytes_total.alias("bytes_total"),
        "packets_fwd", "packets_rev", "bytes_fwd", "bytes_rev", "min_pkt_size", "max_pkt_size",
        (packets_total / duration).alias("packets_per_sec"),
        (bytes_total / duration).alias("bytes_per_sec"),
    )


def stream_rates(df: DataFrame, by: Sequence[str] = (), window: str = "5 minutes", slide: str | None = None) -> DataFrame:
    return M.windowed_rate(df, by, window, slide)


def stream_quantiles(df: DataFrame, col: str, probs: Sequence[float] = (0.5, 0.95, 0.99), window: str = "5 minutes") -> DataFrame:
    return M.windowed_quantiles(df, col, probs, window)


def top_sources_batch(path: str, k: int = 10):
    """``foreachBatch`` step for a stream of per-window rates: ranks the finished windows."""
    from pyspark.sql import Window

    def write(rates: DataFrame, batch_id: int) -> None:
        rank = F.row_number().over(Window.partitionBy("window_start").orderBy(F.desc("n"), F.asc("src_ip")))
        ranked = rates.withColumn("rank", rank).filter(F.col("rank") <= k)
        ranked.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def stream_counters(alerts: DataFrame) -> DataFrame:
    """Running totals per severity (complete output mode)."""
    return alerts.groupBy("severity").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("is_anomaly", F.lit(False))).alias("anomalies")
    )


def observed(df: DataFrame, name: str) -> DataFrame:
    """Count rows and dead letters (``_error`` set) on the way through, as query metrics."""
    bad = F.count("_error") if "_error" in df.columns else F.count(F.lit(None))
    return df.observe(name, F.count(F.lit(1)).alias("rows"), bad.alias("bad"))


def start_file_query(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", once: bool = False, every: str = "10 seconds"):
    """Write a stream to files; the checkpoint folder makes restarts exactly-once."""
    writer = df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def start_routed_topics(alerts: DataFrame, servers: str, checkpoint: str):
    """Alerts to the topic of their severity (the sink honours the ``topic`` column)."""
    from flowspark.functions.scores import route
    from flowspark.sinks.tables import topic_rows

    rows = topic_rows(alerts, "alert_id", route("severity"))
    return rows.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("checkpointLocation", checkpoint).start()
