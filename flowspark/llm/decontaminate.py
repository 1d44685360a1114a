"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Items are partitioned by the number of their shingles. Within a partition every item keeps the same number of smallest
hashes (a bottom-k MinHash sketch), one more than the shingles an item of that partition may miss at the threshold. So an
item contained in a document shares at least one sketch value with it, however long the document is, and the search loses
nothing. Documents probe the sketches through a bitmap of fixed size; exact shingle containment decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm import tokens as T
from flowspark.llm.bitmaps import bitmap, held
from flowspark.llm.shared import written

#: Copies of each sketch row, so that a passage found in very many documents isn't one join key.
SALTS = 8


def _kept(n: np.ndarray, percent: int) -> np.ndarray:
    """Sketch length for sets of n shingles: partitions double in size, the upper bound of each sets its length."""
    upper = (np.int64(1) << (np.floor(np.log2(np.maximum(n, 1))).astype(np.int64) + 1)) - 1
    return np.minimum(n, (100 - percent) * upper // 100 + 1)


def sketch_items(items: DataFrame, item_id: str = "item_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(item_id, n_item, shingles, sketch) of every item that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.pieces(batches):
            owner, value = T.shingles(T.flat(batch.column("text")), n)
            size = np.bincount(owner, minlength=batch.num_rows)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
            low = place < _kept(size, percent)[owner]
            signed = value.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(size, pa.int64()),
                    T.lists(owner, signed, batch.num_rows, pa.int64()), T.lists(owner[low], signed[low], batch.num_rows, pa.int64()),
                ],
                names=["item_id", "n_item", "shingles", "sketch"],
            )

    rows = T.id_text(items, item_id, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"item_id {kind}, n_item long, shingles array<long>, sketch array<long>").filter("n_item > 0")


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", n: int = 5, percent: int = 80, bits: int = 22,
) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared): items of which ``percent`` of 100 shingles or more occur in the document.

    Words are runs of characters other than space and 9..13, A-Z lower-cased; a text with fewer than n words is one
    shingle. Null and empty texts on either side match nothing; a null item id or doc id is kept as it is. Rows with a
    repeated id give one row with the largest overlap. ``bits`` sets the size of the two bitmaps that every task gets
    (2**bits / 8 bytes each); fuller bitmaps only pass more candidates to the joins.
    """
    sketches = sketch_items(items, item_id, item_text, n, percent)
    first = bitmap(sketches.select(F.explode("sketch").alias("v")), bits)
    every = bitmap(sketches.select(F.explode("shingles").alias("v")), bits)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((first, every))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, every = sent.value
        for batch in T.pieces(batches):
            owner, value = T.shingles(T.flat(batch.column("text")), n)
            known = held(every, value, bits)
            owner, value = owner[known], value[known]
            hit = held(first, value, bits)
            found = np.zeros(batch.num_rows, bool)
            found[owner[hit]] = True
            keep = found[owner]
            rows, hits = np.flatnonzero(found), hit & keep
            at = np.cumsum(found) - 1
            signed = value.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows)),
                    T.lists(at[owner[keep]], signed[keep], len(rows), pa.int64()),
                    T.lists(at[owner[hits]], signed[hits], len(rows), pa.int64()),
                ],
                names=["doc_id", "held", "hits"],
            )

    rows = T.id_text(docs, doc_id, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    probed = rows.mapInArrow(probe, f"doc_id {kind}, held array<long>, hits array<long>")
    salt = F.pmod(F.hash("doc_id", F.size("held")), F.lit(SALTS))
    probes = probed.select("doc_id", "held", F.explode("hits").alias("v"), salt.alias("salt"))
    index = sketches.select(
        "item_id", "n_item", "shingles", F.explode("sketch").alias("v"),
    ).select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    shared = F.size(F.array_intersect("held", "shingles")).cast("long")
    return (
        probes.join(index, ["v", "salt"])
        .select("doc_id", "item_id", "n_item", shared.alias("n_shared"))
        .filter(100 * F.col("n_shared") >= percent * F.col("n_item"))
        .groupBy("doc_id", "item_id")
        .agg(F.max("n_item").alias("n_item"), F.max("n_shared").alias("n_shared"))
    )


def drop_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """Documents that hold no benchmark item. Rows with a null id are kept: no match can be traced to them."""
    leaks = written(find_leaks(docs, items, doc_id, **options).select(F.col("doc_id").alias("_leak")).distinct(), "leaks")
    return docs.join(leaks, docs[doc_id] == leaks["_leak"], "left_anti")
