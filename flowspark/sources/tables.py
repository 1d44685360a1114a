"""Readers of records already in JSON or Parquet, rules, and continuous file discovery."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.functions.times import micros
from flowspark.schemas import DETECTION, PACKET_JSON, TRAINING_FLOW


def _kafka(spark: SparkSession, servers: str, topics: Sequence[str], schema: str, stream: bool) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    raw = reader.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("r"), "topic").select("r.*", "topic")


def packet_columns(df: DataFrame) -> DataFrame:
    """JSON packet records with exact microseconds in place of float seconds."""
    return df.withColumn("ts_us", micros("timestamp")).drop("timestamp")


def read_packets(spark: SparkSession, path: str, fmt: str = "json", servers: str | None = None, stream: bool = False) -> DataFrame:
    """Packet records from JSON or Parquet files, or from a topic when ``servers`` is given."""
    if servers:
        return packet_columns(_kafka(spark, servers, [path], PACKET_JSON, stream))
    reader = spark.readStream if stream else spark.read
    df = reader.schema(PACKET_JSON).format(fmt).load(path) if fmt == "json" else reader.format(fmt).load(path)
    return packet_columns(df) if "timestamp" in df.columns else df


def read_flows(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Training flows: Parquet as it is, or JSON (a list, or one object per line).

    Without ``fmt`` a path that ends in ``.parquet`` is Parquet and any other JSON.
    """
    if (fmt or path.lower().rstrip("/").rsplit(".", 1)[-1]) == "parquet":
        return spark.read.parquet(path)
    return spark.read.schema(TRAINING_FLOW).option("multiLine", True).json(path)


def read_detections(spark: SparkSession, paths: Sequence[str], servers: str | None = None, stream: bool = False) -> DataFrame:
    """Detector outputs of several topics or folders as one table; ``source`` names the origin."""
    if servers:
        return _kafka(spark, servers, paths, DETECTION, stream).withColumnRenamed("topic", "source")
    reader = spark.readStream if stream else spark.read
    parts = [reader.schema(DETECTION).json(p).withColumn("source", F.lit(p)) for p in paths]
    return union_detections(*parts)


def union_detections(*parts: DataFrame) -> DataFrame:
    """Detector outputs with any subset of the detection columns."""
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def stream_files(spark: SparkSession, schema: str, path: str, fmt: str = "json", max_files: int = 1000) -> DataFrame:
    """New files of a folder as a stream; the query's checkpoint remembers what was read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt).load(path)


def split_bad(df: DataFrame, ok: Column | str = "_error") -> tuple[DataFrame, DataFrame]:
    """Good rows and dead letters. A column name means an error text (null is good)."""
    if isinstance(ok, str):
        good = F.col(ok).isNull()
        return df.filter(good).drop(ok), df.filter(~good)
    passed = F.coalesce(ok, F.lit(False))
    return df.filter(passed), df.filter(~passed)


RULE = "path STRING, id STRING, title STRING, level STRING, has_selection BOOLEAN"


def _parse_rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml

    for batch in batches:
        rows = []
        for path, text in zip(batch["path"], batch["text"], strict=True):
            try:
                rule = yaml.safe_load(text)
            except yaml.YAMLError:
                continue
            if not isinstance(rule, dict) or "detection" not in rule:
                continue
            detection = rule["detection"]
            rows.append(
                (
                    path,
                    str(rule["id"]) if rule.get("id") else None,
                    str(rule["title"]) if rule.get("title") else None,
                    str(rule.get("level", "medium")) or None,
                    isinstance(detection, dict) and "selection" in detection,
                )
            )
        yield pd.DataFrame(rows, columns=["path", "id", "title", "level", "has_selection"])


def read_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rules of every ``*.yml`` below a folder; unreadable ones and those without detection are skipped."""
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.yml").text(folder, wholetext=True)
    return texts.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).mapInPandas(_parse_rules, RULE)
