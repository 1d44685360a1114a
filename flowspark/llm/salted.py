"""Equi-join for keys that may hold a large share of one side's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "left", salts: int = 32) -> DataFrame:
    """Join where ``right`` has one row per key: it is copied once per salt, and ``spread`` (a column of the left side that
    differs between rows of a key) deals the left rows out over the salts."""
    a = left.withColumn("_salt", F.pmod(F.hash(spread), F.lit(salts)))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*keys, "_salt"], how).drop("_salt")
