"""Writers: topics, routed alerts, event documents, model tables, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.functions.scores import route
from flowspark.operators.board import ecs_event, retention_tier


def topic_rows(df: DataFrame, key: str | None = None, topic: Column | None = None) -> DataFrame:
    """``key, value (JSON), topic`` as the message sinks take them."""
    cols = [F.to_json(F.struct("*")).alias("value")]
    if key:
        cols.insert(0, F.col(key).cast("string").alias("key"))
    if topic is not None:
        cols.append(topic.alias("topic"))
    return df.select(*cols)


def write_topic(df: DataFrame, target: str, servers: str | None = None, key: str | None = None, mode: str = "append") -> None:
    """JSON messages to a topic (all replicas acknowledge, idempotent) or to a folder of JSON lines."""
    rows = topic_rows(df, key)
    if servers:
        (
            rows.write.format("kafka")
            .option("kafka.bootstrap.servers", servers)
            .option("kafka.acks", "all")
            .option("kafka.enable.idempotence", "true")
            .option("topic", target)
            .save()
        )
        return
    rows.select("value").write.mode(mode).text(target)


def write_routed(alerts: DataFrame, path: str, mode: str = "append") -> None:
    """Alerts in one folder per destination topic."""
    alerts.withColumn("topic", route("severity")).write.mode(mode).partitionBy("topic").json(path)


def event_day(ts_us: str = "ts_us") -> Column:
    return F.to_date(F.timestamp_micros(ts_us))


def write_ecs(alerts: DataFrame, path: str, mode: str = "append") -> None:
    """Event documents partitioned by day and severity, so time and severity filters prune files."""
    docs = ecs_event(alerts).withColumns(
        {"day": F.to_date(F.substring("timestamp", 1, 10)), "severity": F.col("event.severity")}
    )
    docs.write.mode(mode).partitionBy("day", "severity").parquet(path)


def read_events(spark: SparkSession, path: str, start: float | None = None, end: float | None = None) -> DataFrame:
    """Event documents as alerts again, for the board's filters, pages, statistics and look-ups.

    ``start`` and ``end`` (seconds) prune the day folders and then cut exactly; a filter on ``severity`` prunes folders too.
    """
    docs = spark.read.parquet(path)
    for limit, day in ((start, F.col("day") >= _day(start)), (end, F.col("day") <= _day(end))):
        if limit is not None:
            docs = docs.filter(day)
    at = F.unix_micros(F.to_timestamp("timestamp"))
    rows = docs.select(
        "alert_id", (at / F.lit(1e6)).alias("timestamp"), at.alias("ts_us"), F.col("alert.type").alias("alert_type"), "severity", "day",
        (F.col("event.outcome") == "success").alias("is_anomaly"), F.col("event.risk_score").alias("risk_score"),
        F.col("source.ip").alias("src_ip"), F.col("source.port").alias("src_port"), F.col("destination.ip").alias("dst_ip"),
        F.col("destination.port").alias("dst_port"), F.col("network.protocol").alias("protocol_name"),
        F.col("alert.score").alias("score"), F.col("alert.model_version").alias("model_version"),
        F.col("alert.inference_time_ms").alias("inference_time_ms"), F.col("correlation.correlation_score").alias("correlation_score"),
        F.col("correlation.correlated_alerts").alias("correlated_alerts"), F.col("correlation.group_id").alias("dedup_key"),
    )
    if start is not None:
        rows = rows.filter(F.col("timestamp") >= start)
    return rows if end is None else rows.filter(F.col("timestamp") <= end)


def _day(seconds: float | None) -> Column:
    return F.to_date(F.timestamp_seconds(F.lit(seconds)))


def write_ecs_batch(path: str):
    """``foreachBatch`` writer: a replayed batch overwrites its own folder, so nothing doubles."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_ecs(batch, f"{path}/batch={batch_id}", mode="overwrite")

    return write


def live_rows(alerts: DataFrame, as_of: Column | str, ts: str = "timestamp") -> DataFrame:
    """Alerts the retention rule still keeps."""
    return retention_tier(alerts, as_of, ts).filter(F.col("tier") != "delete")


def save_model_tables(spark, path: str, threshold: float, means, scales, version: str, importance: DataFrame | None = None, model=None) -> None:
    """Model parameters as small tables beside the saved model."""
    spark.createDataFrame([(float(threshold), version)], "threshold DOUBLE, version STRING").coalesce(1).write.mode(
        "overwrite"
    ).json(f"{path}/threshold")
    pairs = [(i, float(m), float(s)) for i, (m, s) in enumerate(zip(means, scales, strict=True))]
    spark.createDataFrame(pairs, "position INT, mean DOUBLE, scale DOUBLE").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/normalization"
    )
    if importance is not None:
        importance.coalesce(1).write.mode("overwrite").parquet(f"{path}/importance")
    if model is not None:
        model.write().overwrite().save(f"{path}/model")
