"""Ranked lexical search, term at a time with limited accumulators.

Tasks turn blocks of documents into small inverted lists of the terms that any item asks for. In a block an item's terms are
taken rarest first. Every posting of a term opens an accumulator for its document as long as the bounds of this and the
remaining terms together can still reach the k-th best partial score (or the k-th score of the blocks before); from then on
no accumulator is opened, and the ones that exist are looked up in the remaining lists, so their scores become exact.

All scores are 64-bit integers. Items meet blocks in cells that Spark shuffles: a cell holds one block of items and streams
its blocks of documents, and carries each item's k-th score from one to the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm import tokens as T
from flowspark.llm.bitmaps import bitmap, held
from flowspark.llm.shared import written

#: Bytes that end a term are those below 0x80 other than 0-9, A-Z and a-z.
ENDS = np.zeros(256, bool)
ENDS[:128] = True
ENDS[0x30:0x3A] = ENDS[0x41:0x5B] = ENDS[0x61:0x7B] = False

#: Fixed values of the score: saturation (in thousandths), share of the length, and weight scale.
SATURATION, LENGTH_SHARE, FULL = 1000, 90, 1_000_000_000
#: Items in a block; documents' texts in a cell, in characters.
ITEMS, CELL_CHARS = 1024, 1 << 24


def terms(f: T.Flat) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every term, in order."""
    low = T.lowered(f)
    starts, ends, of = T.word_spans(low, ENDS)
    return of, T.span_hashes(low.buf, starts, ends)


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term): the distinct terms of every item."""
    rows = T.id_text(items, id_col, text_col).filter("doc_id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.pieces(batches):
            of, term = terms(T.flat(batch.column("text")))
            of, term = T.distinct_pairs(of, term)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(of)), pa.array(term.view(np.int64))], names=["item_id", "term"])

    return rows.mapInArrow(run, f"item_id {dict(rows.dtypes)['doc_id']}, term long").distinct()


def posting_blocks(docs: DataFrame, id_col: str, text_col: str, asked: DataFrame, bits: int) -> DataFrame:
    """One row per batch of documents: (chars, n_docs, n_terms, ids, given, lengths, terms, counts, places, freqs).

    ``n_docs`` counts the documents with a term, ``n_terms`` all their terms; ``terms`` (sorted hashes, among them all that
    ``asked`` holds) have ``counts`` postings each, and a posting is a document's place in the batch with its frequency.
    """
    rows = T.id_text(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(asked.select(F.col("term").alias("v")).distinct(), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        for batch in T.pieces(batches):
            f = T.flat(batch.column("text"))
            of, term = terms(f)
            lengths = np.bincount(of, minlength=len(f))
            keep = held(wanted, term, bits)
            order = np.lexsort((of[keep], term[keep]))
            of, term = of[keep][order], term[keep][order]
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (term[1:] != term[:-1])
            at = np.flatnonzero(new)
            freq = np.diff(np.append(at, len(of)))
            of, term = of[at], term[at]
            first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
            count = np.diff(np.append(first, len(term)))
            ids = batch.column("doc_id")
            given = np.asarray(ids.is_valid())
            kinds = [pa.int64()] * 3 + [pa.binary()] * 7
            values = [
                len(f.buf), int(np.count_nonzero(lengths)), int(lengths.sum()), np.asarray(ids.fill_null(0)).astype(np.int64).tobytes(), given.tobytes(),
                lengths.astype(np.int64).tobytes(), term[first].tobytes(), count.astype(np.uint32).tobytes(), of.astype(np.uint32).tobytes(), freq.astype(np.uint32).tobytes(),
            ]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=BLOCK)

    return rows.mapInArrow(run, "chars long, n_docs long, n_terms long, ids binary, given binary, lengths binary, terms binary, counts binary, places binary, freqs binary")


BLOCK = ["chars", "n_docs", "n_terms", "ids", "given", "lengths", "terms", "counts", "places", "freqs"]


def document_counts(blocks: DataFrame) -> DataFrame:
    """(term, df) over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, c in zip(batch.column("terms"), batch.column("counts")):
                term, count = np.frombuffer(t.as_py(), np.int64), np.frombuffer(c.as_py(), np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(count.astype(np.int64))], names=["term", "n"])

    return blocks.select("terms", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


class Index:
    """One block of documents: the inverted lists with each posting's share of the score, before the term's weight."""

    def __init__(self, row: dict, n: int, total: int):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.given = np.frombuffer(row["given"], bool)
        lengths = np.frombuffer(row["lengths"], np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        ends = np.cumsum(np.frombuffer(row["counts"], np.uint32).astype(np.int64))
        self.bounds = np.concatenate(([0], ends))
        self.places = np.frombuffer(row["places"], np.uint32).astype(np.int64)
        freq = np.frombuffer(row["freqs"], np.uint32).astype(np.int64)
        m = 100 - LENGTH_SHARE + (LENGTH_SHARE * lengths * n) // max(total, 1)
        self.shares = (FULL * freq) // (SATURATION * freq + 8 * m[self.places])
        self.most = np.maximum.reduceat(self.shares, self.bounds[:-1]) if len(ends) else np.zeros(0, np.int64)

    def postings(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.bounds[at], self.bounds[at + 1])
        return self.places[part], self.shares[part]


def search_block(index: Index, term: np.ndarray, weight: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the block's documents that can be among the best k, all of them exact.

    ``term`` and ``weight`` are an item's terms, rarest first; scores below ``least`` (k documents reach it) are of no use.
    """
    at = np.searchsorted(index.terms, term)
    here = (at < len(index.terms)) & (index.terms[np.minimum(at, len(index.terms) - 1)] == term) if len(index.terms) else np.zeros(len(term), bool)
    at, weight = at[here], weight[here]
    bound = index.most[at] * weight
    rest = np.cumsum(bound[::-1])[::-1]  # of this term and all after it
    score = np.zeros(len(index.ids), np.int64)
    opened = np.zeros(len(index.ids), bool)
    i, kth = 0, max(least, 1)
    while i < len(at) and rest[i] >= kth:
        place, share = index.postings(at[i])
        score[place] += weight[i] * share
        opened[place] = True
        i += 1
        partial = score[opened & index.given]
        if len(partial) >= k:
            kth = max(kth, int(np.partition(partial, len(partial) - k)[len(partial) - k]))
    found = np.flatnonzero(opened & index.given)
    exact = score[found]
    for j in range(i, len(at)):
        place, share = index.postings(at[j])
        # whom the remaining terms can't lift to the k-th partial score is left behind
        alive = exact + rest[j] >= kth
        found, exact = found[alive], exact[alive]
        if not len(found):
            break
        spot = np.minimum(np.searchsorted(place, found), len(place) - 1)
        exact = exact + np.where(place[spot] == found, weight[j] * share[spot], 0)
    return found, exact


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores above 0, equal ones by ascending id."""
    real = scores > 0
    ids, scores = ids[real], scores[real]
    if len(ids) > 4 * k:
        real = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[real], scores[real]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", bits: int = 24) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest score above 0 for each item.

    Terms are runs of letters and digits of ASCII and of all characters beyond it, only A-Z lower-cased; null and empty texts
    have none. A term's weight is floor(1000 * ln((2N+2) / (2df+1))), its part of a score weight * (10^9 tf div (1000 tf + 8m))
    with m = 10 + 90 n N div L. Equal scores go by ascending doc_id. Items without a term that a document holds give no rows,
    nor do empty tables; rows that repeat an item_id count as one item with the terms of all. Repeated documents count and
    rank each; a document with a null id counts in N, L and df but isn't ranked; items with a null id are left out. Terms are
    known by 64-bit hashes. Jobs that run while the query is built give the terms' bitmap, of a fixed size, which is
    broadcast, and three counts.
    """
    asked = written(item_terms(items, item_id, item_text), "item_terms")
    blocks = written(posting_blocks(docs, doc_id, doc_text, asked, bits), "postings")
    whole = blocks.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l"), F.sum("chars").alias("c")).first()
    n, total, chars = (int(v or 0) for v in whole)
    item_blocks = max(1, -(-asked.select("item_id").distinct().count() // ITEMS))
    cells = max(24, chars // CELL_CHARS)
    df = F.col("df").cast("double")
    known = asked.join(document_counts(blocks), "term").withColumn("w", F.floor(1000 * F.log((F.lit(2.0 * n) + 2) / (2 * df + 1))).cast("long"))
    kind = dict(asked.dtypes)["item_id"]
    dealt = known.withColumn("item_block", F.pmod(F.xxhash64("item_id"), F.lit(item_blocks)).cast("int"))
    one = dealt.groupBy("item_block", "item_id").agg(F.array_sort(F.collect_list(F.struct("df", "term", "w"))).alias("t"))
    none = F.lit(None)
    lists = one.select(
        F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), "item_block", F.lit(0).alias("side"), "item_id",
        F.col("t.term").alias("term"), F.col("t.w").alias("w"), *[none.cast("long" if c in BLOCK[:3] else "binary").alias(c) for c in BLOCK],
    )
    spread = blocks.withColumn("cell", F.pmod(F.xxhash64("ids", "lengths"), F.lit(cells)).cast("int"))
    spread = spread.select(
        "cell", F.explode(F.sequence(F.lit(0), F.lit(item_blocks - 1))).alias("item_block"), F.lit(1).alias("side"), none.cast(kind).alias("item_id"),
        none.cast("array<long>").alias("term"), none.cast("array<long>").alias("w"), *BLOCK,
    )
    met = lists.unionByName(spread).repartition(cells * item_blocks, "cell", "item_block").sortWithinPartitions("cell", "item_block", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, state = None, []

        def result() -> pa.RecordBatch:
            rows = [(s[0], i, x) for s in state for i, x in zip(s[3].tolist(), s[4].tolist())]
            columns = [pa.array([r[c] for r in rows], t) for c, t in enumerate((item_type, pa.int64(), pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names=["item_id", "doc_id", "score"])

        for batch in batches:
            item_type = batch.column("item_id").type
            for i in range(batch.num_rows):
                now = batch.column("cell")[i].as_py(), batch.column("item_block")[i].as_py()
                if now != cell:
                    if state:
                        yield result()
                    cell, state = now, []
                if batch.column("side")[i].as_py() == 0:
                    term, w = (np.asarray(batch.column(c)[i].values) for c in ("term", "w"))
                    state.append([batch.column("item_id")[i].as_py(), term.view(np.uint64), w, np.zeros(0, np.int64), np.zeros(0, np.int64)])
                    continue
                if not state:
                    continue
                index = Index({c: batch.column(c)[i].as_py() for c in BLOCK}, n, total)
                for s in state:
                    least = int(s[4][-1]) if len(s[4]) == k else 0
                    place, score = search_block(index, s[1], s[2], k, least)
                    s[3], s[4] = best_of(np.concatenate((s[3], index.ids[place])), np.concatenate((s[4], score)), k)
        if state:
            yield result()

    best = met.mapInArrow(run, f"item_id {kind}, doc_id long, score long")
    place = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return best.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
