"""Bitmaps of fixed size that tasks use to pass over rows without a partner; an exact join follows them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmap(values: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of 2**bits places over a long column ``v``; the size doesn't depend on the number of rows."""
    place = F.col("v").bitwiseAND(F.lit((1 << bits) - 1))
    words = values.select(place.alias("p")).groupBy(F.expr("shiftright(p, 5)").alias("w")).agg(
        F.expr("bit_or(shiftleft(1L, cast(p & 31 as int)))").alias("b")
    )
    got = words.toPandas()  # 2**(bits - 5) rows at most
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64).astype(np.uint32)
    return out


def held(map_: np.ndarray, value: np.ndarray, bits: int) -> np.ndarray:
    """Whether the place of each value is set."""
    place = value & np.uint64((1 << bits) - 1)
    return (map_[(place >> np.uint64(5)).astype(np.int64)] >> (place & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
