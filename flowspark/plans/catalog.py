"""Registry of the queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.session import compiled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` and, where SQL can say it, its counterpart."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return compiled(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *key: str) -> DataFrame:
    """Rows dealt over all tasks by ``key``, for work that follows a scan without a shuffle. A file is split at its row groups
    only: a table of one large group (as the given ones are) would be worked on by one task. The number of tasks is named, so
    that they aren't joined again for their few bytes: the work is in what is made of them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def q4(c: Column | str) -> Column:
    """Round to 4 places for comparison; the offset keeps exact halves away from the cut."""
    value = F.col(c) if isinstance(c, str) else c
    return F.floor(value * F.lit(1e4) + F.lit(0.50123)) / F.lit(1e4)


def sql_q4(expr: str) -> str:
    return f"(floor(CAST({expr} AS DOUBLE) * CAST(1e4 AS DOUBLE) + CAST(0.50123 AS DOUBLE)) / CAST(1e4 AS DOUBLE))"
