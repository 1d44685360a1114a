"""Ethernet frames to five-tuples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions.keys import be_ipv4, be_uint, directed_key

ETHERNET, IPV4 = 14, 0x0800


def frame_tuple(frame: Column) -> Column:
    """``src_ip, dst_ip, src_port, dst_port, protocol`` of an Ethernet II / IPv4 / TCP or UDP frame.

    Null for anything else, including frames cut inside a header.
    """
    n = F.octet_length(frame)
    first = be_uint(frame, ETHERNET + 1, 1)
    header = first.bitwiseAND(F.lit(15)) * 4
    protocol = be_uint(frame, ETHERNET + 10, 1).cast("int")
    ports = (F.lit(ETHERNET) + header).cast("int")
    ok = (
        (n >= ETHERNET + 20)
        & (be_uint(frame, 13, 2) == IPV4)
        & (F.shiftright(first, 4) == 4)
        & protocol.isin(6, 17)
        & (n - ETHERNET >= header)
        & (n - ETHERNET - header >= 4)
    )
    return F.when(
        ok,
        F.struct(
            be_ipv4(frame, ETHERNET + 13).alias("src_ip"),
            be_ipv4(frame, ETHERNET + 17).alias("dst_ip"),
            be_uint(frame, ports + 1, 2).cast("int").alias("src_port"),
            be_uint(frame, ports + 3, 2).cast("int").alias("dst_port"),
            protocol.alias("protocol"),
        ),
    )


def decode_frames(df: DataFrame, frame_col: str = "frame") -> DataFrame:
    """Add the five-tuple and directed key; frames that do not decode are dropped."""
    # inside a generator, each frame is decoded once (a filter would decode it again)
    tuples = F.filter(F.transform(F.array(frame_col), frame_tuple), lambda t: t.isNotNull())
    return df.select("*", F.inline(tuples)).withColumn("flow_key", directed_key())


def captured_frames(df: DataFrame, data: str = "data") -> DataFrame:
    """Base64 text of captured frames as binary ``frame``."""
    return df.withColumn("frame", F.try_to_binary(F.col(data), F.lit("base64")))
