"""Words, hashes and shingles of whole Arrow batches of texts, in numpy.

Helpers for the Arrow functions of this folder. A word is a run of bytes other than space and 9..13; words never cross
rows. Hashes are 64-bit and depend only on the bytes, so they agree between tasks and runs.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20
SLICE = 1 << 15
_RATIO = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche; works on uint64 with wrap-around."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int) -> np.ndarray:
    out = np.full(SLICE + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_RATIO))
_R = 0xD1342543DE82EF95
_POW, _INV = _powers(_R), _powers(pow(_R, -1, 1 << 64))
_SEP = np.zeros(256, dtype=bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes where the session has no bound of its own, so that long texts don't pile up."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1)).rstrip("bB")) >= 2**31 - 1:
        spark.conf.set(key, str(BATCH_BYTES))


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, as (doc_id, text); other columns can't clash with its own."""
    bound_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def remainder(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % modulus


@dataclass
class Flat:
    """Bytes of all texts of a batch, one after the other: text i is buf[offsets[i]:offsets[i + 1]]."""

    buf: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The text that holds each byte position."""
        return np.searchsorted(self.offsets, at, side="right") - 1

    def per_text(self, positions: np.ndarray) -> np.ndarray:
        """How many of the sorted byte positions lie in each text."""
        return np.diff(np.searchsorted(positions, self.offsets))


def flat(texts: pa.Array | pa.ChunkedArray) -> Flat:
    """Null counts as the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Flat(buf[offsets[0] : offsets[-1]], offsets - offsets[0])


def lowered(f: Flat) -> Flat:
    """A-Z to a-z, all other bytes as they are."""
    return Flat(_LOWER[f.buf], f.offsets)


def word_spans(f: Flat, separators: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of every word, in order; ``separators`` tells for each byte whether it ends a word."""
    if not len(f.buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    sep = separators[f.buf]
    edge = np.zeros(len(sep) + 1, dtype=bool)
    edge[f.offsets] = True
    before = np.concatenate(([True], sep[:-1])) | edge[:-1]
    after = np.concatenate((sep[1:], [True])) | edge[1:]
    starts = np.flatnonzero(~sep & before)
    ends = np.flatnonzero(~sep & after) + 1
    return starts, ends, f.owner(starts)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of buf[start:end] for sorted, non-overlapping spans; memory is one slice beside the result."""
    total, base_pow, base_inv = np.uint64(0), np.uint64(1), np.uint64(1)
    head = np.zeros(len(starts), np.uint64)
    back = np.zeros(len(starts), np.uint64)
    tail = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for base in range(0, len(buf) + 1, SLICE):
            part = buf[base : base + SLICE]
            run = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE[part] * _POW[: len(part)], out=run[1:])
            run = run * base_pow + total
            a, b = np.searchsorted(starts, (base, base + SLICE))
            at = starts[a:b] - base
            head[a:b], back[a:b] = run[at], _INV[at] * base_inv
            a, b = np.searchsorted(ends, (base, base + SLICE))
            tail[a:b] = run[ends[a:b] - base]
            total = run[-1]
            base_pow, base_inv = base_pow * _POW[SLICE], base_inv * _INV[SLICE]
        size = (ends - starts).astype(np.uint64)
        return mix64((tail - head) * back + size * np.uint64(_RATIO))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes (of all, across texts too; see ``whole_runs``)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(m, n, np.uint64)
        for j in range(n):
            out = out * np.uint64(_R) + words[j : j + m]
        return mix64(out)


def whole_runs(text_of: np.ndarray, n: int) -> np.ndarray:
    """Whether the run of n words that starts here lies in one text."""
    m = len(text_of) - n + 1
    return text_of[:m] == text_of[n - 1 :] if m > 0 else np.zeros(0, bool)


def distinct_pairs(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, value) rows, sorted by owner and then value."""
    order = np.argsort(owner, kind="stable")  # merges runs that are sorted already
    owner, value = owner[order], value[order]
    cuts = np.concatenate((np.flatnonzero(owner[1:] != owner[:-1]) + 1, [len(owner)]))
    at = 0
    for stop in cuts.tolist():
        value[at:stop].sort()
        at = stop
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[first], value[first]


def shingles(f: Flat, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each text's distinct n-word shingles of lower-cased words, sorted.

    A text with fewer words has one shingle, its whole word sequence; a text without words has none.
    """
    low = lowered(f)
    starts, ends, text_of = word_spans(low)
    words = span_hashes(low.buf, starts, ends)
    full = whole_runs(text_of, n)
    owner, value = text_of[: len(full)][full], gram_hashes(words, n)[full]
    counts = np.bincount(text_of, minlength=len(f)) if len(f) else np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        first = np.searchsorted(text_of, short)
        extra = np.zeros(len(short), np.uint64)
        for size in range(1, n):
            at = np.flatnonzero(counts[short] == size)
            with np.errstate(over="ignore"):
                acc = np.full(len(at), size, np.uint64)
                for j in range(size):
                    acc = acc * np.uint64(_R) + words[first[at] + j]
            extra[at] = mix64(acc)
        owner, value = np.concatenate((owner, short)), np.concatenate((value, extra))
    return distinct_pairs(owner, value)


def give_back() -> None:
    """Return free memory to the system at a task's end: worker processes stay, and stand idle while other stages run."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        at, size = 0, np.diff(flat(batch.column(text)).offsets)
        ends = np.cumsum(size)
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop
    give_back()


def lists(owner: np.ndarray, value: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    """Values grouped into one list for each of n owners; ``owner`` is sorted."""
    cuts = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(value, kind))
