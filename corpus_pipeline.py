"""Documents to clean token sequences: five stages over the whole table, each written and read again.

Every stage takes the documents that the stage before kept and returns the columns of ``documents``; the last one returns
a digest of each text's tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm import decontaminate, jaccard_join, language, secrets, sentence_pieces
from flowspark.llm.shared import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of an Arrow batch: the stages' Python workers stay alive beside each other, so they get half of the usual size.
BATCH_BYTES = 4 << 20


def columns_of(docs: DataFrame) -> DataFrame:
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs.select(COLUMNS)


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without text, without a letter, or that fit no language clearly go."""
    return language.keep_identified(columns_of(docs), language.fit(docs))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id."""
    return jaccard_join.keep_first(columns_of(docs))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(columns_of(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    hidden = secrets.redact(columns_of(docs), secrets.train(docs))
    length = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
    return hidden.withColumn("n_chars", length.cast("long")).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_digest, text_digest, round_trip) of every document, after decoding its ids again."""
    return sentence_pieces.round_trip(columns_of(docs), sentence_pieces.load())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identified),
    ("jaccard_join", distinct),
    ("decontamination", decontaminated),
    ("secret_scan", redacted),
    ("sentence_pieces", tokens),
]
# the forest, the language model and the piece scores have no form in SQL; tests/llm hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
