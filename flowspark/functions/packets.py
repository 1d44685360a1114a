"""Per-packet payload functions: application tagging and byte entropy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.functions.keys import col

HTTP_PORTS = (80, 8080, 8000)  # fixed values


def _bytes_as_text(c: Column) -> Column:
    """One character per byte, so string functions see the raw bytes."""
    return F.decode(c, "ISO-8859-1")


def _text_as_utf8(c: Column) -> Column:
    """Back from one character per byte to UTF-8; undecodable bytes are dropped."""
    raw = F.encode(c, "ISO-8859-1").cast("string")
    return F.replace(F.make_valid_utf8(raw), F.lit("�"), F.lit(""))


def dns_query() -> Column:
    """First 64 bytes of a standard DNS query on port 53 either side, else null."""
    payload = F.col("payload")
    return F.when(
        ((F.col("src_port") == 53) | (F.col("dst_port") == 53))
        & (F.octet_length(payload) >= 12)
        & (F.substring(payload, 3, 2) == F.lit(b"\x01\x00")),
        F.substring(payload, 1, 64),
    )


def http_host() -> Column:
    """Text between the first ``Host: `` and the next CRLF of a GET or POST, else null."""
    payload = F.col("payload")
    verb = F.substring(payload, 1, 4)
    pattern = r"(?s)^.*?Host: (.*?)\r\n"
    text = _bytes_as_text(payload)
    return F.when(
        F.col("dst_port").isin(*HTTP_PORTS)
        & ((verb == F.lit(b"GET ")) | (verb == F.lit(b"POST")))
        & text.rlike(pattern),
        _text_as_utf8(F.regexp_extract(text, pattern, 1)),
    )


def tls_hello() -> Column:
    """``handshake`` for a TLS handshake record sent to port 443, else null."""
    first = F.substring(F.col("payload"), 1, 1)
    return F.when((F.col("dst_port") == 443) & (first == F.lit(b"\x16")), F.lit("handshake"))


def tag_app_layer(df: DataFrame) -> DataFrame:
    return df.withColumns({"dns_query": dns_query(), "http_host": http_host(), "tls": tls_hello()})


@F.pandas_udf(T.DoubleType())
def _entropy_of_bytes(values: pd.Series) -> pd.Series:
    data = [v or b"" for v in values]
    size = np.array([len(v) for v in data], dtype=np.int64)
    out = np.zeros(len(data))
    # one histogram of (row, byte) for some rows at a time
    for at in range(0, len(data), 1024):
        part = size[at : at + 1024]
        flat = np.frombuffer(b"".join(data[at : at + 1024]), np.uint8)
        cell = np.repeat(np.arange(len(part)) * 256, part) + flat
        share = np.bincount(cell, minlength=len(part) * 256).reshape(-1, 256) / np.maximum(part, 1)[:, None]
        logs = np.log2(share, out=np.zeros_like(share), where=share > 0)
        out[at : at + 1024] = np.abs((share * logs).sum(axis=1))
    return pd.Series(out)


def payload_entropy(c: str | Column, max_bytes: int | None = 256) -> Column:
    """Shannon entropy in bits per byte over the first ``max_bytes`` bytes.

    The short sample of a flow stays in the JVM. ``None`` takes the whole value, where one
    pass of a byte histogram over Arrow batches beats one string scan per distinct byte.
    """
    value = col(c)
    if max_bytes is None:
        return _entropy_of_bytes(value)
    sample = F.substring(value, 1, max_bytes)

    def bits_of(text: Column) -> Column:
        symbols = F.filter(F.array_distinct(F.split(text, "")), lambda s: F.octet_length(s) > 0)

        def term(acc: Column, s: Column) -> Column:
            p = (F.length(text) - F.length(F.replace(text, s, F.lit("")))) / F.length(text)
            return acc - p * F.log2(p)

        return F.aggregate(symbols, F.lit(0.0), term)

    # the one-element transform binds the decoded text once for all symbols
    bits = F.get(F.transform(F.array(_bytes_as_text(sample)), bits_of), F.lit(0))
    return F.when(F.octet_length(sample) > 0, F.abs(bits)).otherwise(F.lit(0.0))
