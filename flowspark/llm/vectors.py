"""Vectors of whole Arrow batches as integer matrices, in numpy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa

INTS = (np.int16, np.int32, np.int64)


def usable(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, sizes, values): the rows that hold a list of finite numbers only, their lengths and their numbers in a row.

    A null list, a null entry, NaN and infinity make a row unusable; an empty list is usable.
    """
    n = len(lists)
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    flat = lists.values
    numbers = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)  # null entries become NaN
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(numbers))))
    given = np.ones(n, bool) if not lists.null_count else ~np.asarray(lists.is_null())
    good = given & (bad[offsets[1:]] == bad[offsets[:-1]])
    rows = np.flatnonzero(good)
    sizes = offsets[rows + 1] - offsets[rows]
    if len(rows) == n and n:
        return rows, sizes, numbers[offsets[0] : offsets[-1]]
    held = np.repeat(offsets[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    return rows, sizes, numbers[held]


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value) as long; numbers that no long can hold raise an error."""
    out = np.floor(values * float(scale))
    if len(out) and np.abs(out).max() >= 2.0**63:
        raise OverflowError("a scaled component exceeds a long")
    return out.astype(np.int64)


def matrix(values: np.ndarray, sizes: np.ndarray, width: int = 0) -> np.ndarray:
    """Rows of the given lengths, filled up with zeros to the longest (or to ``width``)."""
    width = max(width, int(sizes.max(initial=0)))
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), values.dtype)
    of = np.repeat(np.arange(len(sizes)), sizes)
    out[of, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def packed(x: np.ndarray) -> bytes:
    """The numbers in the narrowest kind that holds them; the first byte tells it."""
    top = int(np.abs(x).max(initial=0))
    kind = next(i for i, t in enumerate(INTS) if top <= np.iinfo(t).max)
    return bytes([kind]) + x.astype(INTS[kind]).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, INTS[raw[0]], offset=1)


def stacked(rows: Sequence[bytes]) -> np.ndarray:
    """Packed vectors as one matrix, filled up with zeros to the longest."""
    if len({(r[0], len(r)) for r in rows}) == 1:
        kind = np.dtype(INTS[rows[0][0]])
        whole = np.frombuffer(b"".join(r[1:] for r in rows), kind)
        return whole.reshape(len(rows), -1) if len(rows[0]) > 1 else np.zeros((len(rows), 0), kind)
    parts = [unpacked(r) for r in rows]
    return matrix(np.concatenate([p.astype(np.int64) for p in parts]), np.array([len(p) for p in parts]))


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))
