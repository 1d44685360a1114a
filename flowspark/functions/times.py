"""Timestamp conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowspark.functions.keys import col


def epoch_from_rfc3339(c: str | Column) -> Column:
    """ISO timestamp with optional zone (default UTC) to epoch seconds; unreadable gives 0."""
    return F.coalesce(F.unix_micros(col(c).try_cast("timestamp")) / F.lit(1e6), F.lit(0.0))


def zeek_ts(c: str | Column) -> Column:
    """Epoch seconds written as text; unreadable gives 0."""
    return F.coalesce(col(c).try_cast("double"), F.lit(0.0))


def micros(c: str | Column) -> Column:
    """Epoch seconds (double) to whole microseconds."""
    return F.round(col(c) * F.lit(1e6)).cast("long")


def ts_of_micros(c: str | Column) -> Column:
    return F.timestamp_micros(col(c))


def iso(c: Column, suffix: str = "") -> Column:
    """UTC ISO text the way Python prints it: fraction only when not zero."""
    ts = F.timestamp_micros(c)
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micro = F.pmod(c, F.lit(1000000))
    fraction = F.when(micro != 0, F.concat(F.lit("."), F.lpad(micro.cast("string"), 6, "0"))).otherwise("")
    return F.concat(whole, fraction, F.lit(suffix))
