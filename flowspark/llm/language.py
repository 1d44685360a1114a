"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts are summed in numpy per task and by Spark across tasks; the log-probability matrix (languages x buckets) is
broadcast, and each batch gathers only the matrix rows of the n-grams it holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm import tokens as T

UNKNOWN = "und"
#: n-grams hashed at a time.
WINDOW = 1 << 19


@dataclass(frozen=True)
class LanguageModel:
    """logp[bucket, language], prior[language]; languages are sorted, so ties go to the first name."""

    languages: tuple[str, ...]
    logp: np.ndarray
    prior: np.ndarray
    orders: tuple[int, ...]


def _code_points(f: T.Flat) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of a batch with A-Z lower-cased."""
    low = T.lowered(f).buf
    points = np.frombuffer(low.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((low & 0xC0) == 0x80)
    return points, f.offsets - np.searchsorted(lead, f.offsets)


def grams(points: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of the n-grams of all texts, a window at a time; n-grams never cross texts."""
    longest = max(orders)
    for base in range(0, len(points), WINDOW):
        part = points[base : base + WINDOW + longest - 1].astype(np.uint64)
        text_of = np.searchsorted(offsets, np.arange(base, base + len(part)), side="right") - 1
        own = min(WINDOW, len(points) - base)
        with np.errstate(over="ignore"):
            acc = np.zeros(len(part), np.uint64)
            for n in range(1, longest + 1):
                m = len(part) - n + 1
                if m <= 0:
                    break
                acc = acc[:m] * np.uint64(0x9E3779B97F4A7C15) + part[n - 1 :] + np.uint64(n)
                if n in orders:
                    whole = np.flatnonzero(text_of[: min(m, own)] == text_of[n - 1 : n - 1 + min(m, own)])
                    # multiply-shift: the top bits are well mixed
                    top = (acc[whole] ^ (acc[whole] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    yield text_of[whole], (top >> np.uint64(40)).astype(np.int64) % buckets


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", orders: tuple[int, ...] = (1, 2, 3), buckets: int = 1 << 15,
        smoothing: float = 0.5, max_languages: int = 1000) -> LanguageModel:
    """Learn from every row with text and a language. Without such rows the model knows no language.

    The driver gets languages x buckets counts; more than ``max_languages`` languages raise an error.
    """
    T.bound_batches(df.sparkSession)
    rows = df.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(
        "text is not null and lang is not null"
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in T.pieces(batches):
            names, code = np.unique(np.asarray(batch.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
            f = T.flat(batch.column("text"))
            block = np.zeros(len(names) * buckets, np.int64)
            for text_of, bucket in grams(*_code_points(f), orders, buckets):
                block += np.bincount(code[text_of] * buckets + bucket, minlength=len(block))
            for i, name in enumerate(names.tolist()):
                own = sums.setdefault(name, np.zeros(buckets + 1, np.int64))
                own[:buckets] += block[i * buckets : (i + 1) * buckets]
                own[buckets] += np.count_nonzero(code == i)
        for name, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "bucket", "n"]
            )

    sums = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    if rows.select("lang").distinct().limit(max_languages + 1).count() > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    got = sums.toPandas()
    languages = tuple(sorted(got["lang"].unique()))
    matrix = np.zeros((buckets + 1, len(languages)))
    at = got["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy(np.int64)
    matrix[got["bucket"].to_numpy(np.int64), at] = got["n"]
    counts, texts = matrix[:buckets] + smoothing, matrix[buckets]
    logp = np.log(counts / counts.sum(axis=0)) if languages else counts
    return LanguageModel(languages, logp.astype(np.float32), np.log(np.maximum(texts, 1) / max(texts.sum(), 1)), orders)


def score_texts(model: LanguageModel, f: T.Flat) -> tuple[np.ndarray, np.ndarray]:
    """(index of the best language, its posterior probability) of each text."""
    total = np.tile(model.prior, (len(f), 1))
    for text_of, bucket in grams(*_code_points(f), model.orders, model.logp.shape[0]):
        if len(text_of):
            first = np.flatnonzero(np.concatenate(([True], text_of[1:] != text_of[:-1])))
            total[text_of[first]] += np.add.reduceat(model.logp[bucket], first, axis=0, dtype=np.float64)
    best = total.argmax(axis=1)
    top = total[np.arange(len(f)), best]
    return best, 1 / np.exp(total - top[:, None]).sum(axis=1)


def predict(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, lang_pred, score) per row; ``extra`` columns of the input are carried along.

    ``und`` with score 0 where the text is null, has no letter, or the model knows no language. Equal scores go to the
    language that sorts first; repeated rows are scored each.
    """
    T.bound_batches(df.sparkSession)
    extra = extra or {}
    text = F.col(text_col).cast("string")
    rows = df.select(
        *[c.alias(name) for name, c in extra.items()], F.col(id_col).alias("doc_id"), text.alias("text"),
        F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("_letters"),
    )
    parts = (model.languages, model.logp, model.prior, model.orders)  # plain values: a broadcast needs no class of ours
    sent, carried = df.sparkSession.sparkContext.broadcast(parts), list(extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LanguageModel(*sent.value)
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in T.pieces(batches):
            letters = batch.column("_letters").to_numpy(zero_copy_only=False)
            if model.languages:
                best, score = score_texts(model, T.flat(batch.column("text")))
            else:
                best, score, letters = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in carried), batch.column("doc_id"),
                    pa.array(names[np.where(letters, best, len(names) - 1)], pa.string()), pa.array(np.where(letters, score, 0.0)),
                ],
                names=[*carried, "doc_id", "lang_pred", "score"],
            )

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in [*carried, "doc_id"]), "lang_pred string, score double"]))


def keep_identified(df: DataFrame, model: LanguageModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose text has a language: not ``und``, and a score of ``least`` or more."""
    T.bound_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast((model.languages, model.logp, model.prior, model.orders))
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LanguageModel(*sent.value)
        for batch in batches:
            _, score = score_texts(model, T.flat(batch.column(place).cast(pa.string())))
            yield batch.filter(pa.array(score >= least))

    if not model.languages:
        return df.limit(0)
    return df.filter(F.col(text_col).cast("string").rlike(r"\p{L}")).mapInArrow(run, df.schema)


def identify(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Learn from the rows where ``learn`` holds and predict every row: (doc_id, lang_pred, score)."""
    return predict(df, fit(df.filter(learn), text_col, lang_col, **options), id_col, text_col)
