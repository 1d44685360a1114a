"""Walks over packed binary columns: all rows of an Arrow batch at once, a step per section."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end) of a binary column without nulls."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    n, raw = len(column), column.buffers()[2]
    cuts = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    return np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8), cuts[:-1], cuts[1:]


def uint(buf: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Big-endian unsigned integers of ``width`` bytes at ``at``, which must lie inside."""
    out = np.zeros(len(at), np.int64)
    for i in range(width):
        out = (out << 8) | buf[at + i]
    return out


def uint_or(buf: np.ndarray, at: np.ndarray, end: np.ndarray, width: int, missing: int = -1) -> np.ndarray:
    """The same, ``missing`` where the number doesn't end before ``end``."""
    out = np.full(len(at), missing, np.int64)
    whole = at + width <= end
    out[whole] = uint(buf, at[whole], width)
    return out


def int32(value: np.ndarray) -> np.ndarray:
    """Unsigned numbers of four bytes as signed ones."""
    return np.where(value >= 1 << 31, value - (1 << 32), value)


def slices(column: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Byte ranges as a binary column."""
    size = end - start
    cuts = np.concatenate(([0], np.cumsum(size)))
    if cuts[-1] >= 1 << 31:
        raise ValueError("more than 2 GB of sections in a batch; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    where = np.repeat(start - cuts[:-1], size) + np.arange(cuts[-1])
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(column[where].tobytes())])


def sections(
    buf: np.ndarray, start: np.ndarray, end: np.ndarray, head: int, steps: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, from, to) of consecutive sections, in order of their rows; a row stops at its first cut one.

    A head is an id and a length of half its bytes each. Lengths of four-byte heads count the head, those of eight-byte
    heads don't. ``steps`` limits the sections of a row, one is always tried.
    """
    half = head // 2
    live, at, turn, found = np.arange(len(start)), start.copy(), 0, []
    while len(live):
        live = live[at[live] + head <= end[live]]
        p = at[live]
        size = uint(buf, p + half, half) + (0 if head == 4 else head)
        ok = (size >= head) & (p + size <= end[live])
        live, p, size = live[ok], p[ok], size[ok]
        found.append((live, uint(buf, p, half), p + head, p + size))
        at[live] = p + size
        turn += 1
        if steps is not None:
            live = live[steps[live] > turn]
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    row, number, a, b = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(row, kind="stable")
    return row[order], number[order], a[order], b[order]
