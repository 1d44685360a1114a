"""Exact top-k search by inner product over buckets of vectors of like length.

Vectors are sorted by length, longest first, and cut into buckets. A query that knows a lower bound of its k-th score needs
nothing of a bucket whose longest vector can't reach it. Else the bound, divided by both lengths, is the bucket's local
cosine threshold. Where it is high, coordinate pruning looks up, in the bucket's sorted coordinates, the vectors whose value
on a large coordinate of the query allows that cosine; where it is low, length pruning takes the front of the bucket up to
the last vector that is long enough. The products of what is left are computed exactly, and the bound rises as a query goes
from bucket to bucket.

Query blocks meet blocks of buckets in cells that Spark shuffles; a cell streams its buckets, so a task holds one query block
and one bucket. The first bounds come from the bucket of the longest vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm import tokens as T
from flowspark.llm import vectors as V
from flowspark.llm.shared import written

#: Vectors in a bucket, in a block of buckets, and queries in a block.
BUCKET, BLOCK, QUERIES = 2048, 1 << 17, 8192
#: Local cosine thresholds from which coordinates prune.
COSINE = 0.8
#: Coordinates of a query that are tried for pruning.
FOCUS = 3
#: Queries whose products with a bucket stand in memory together.
TILE = 1024
SLACK = 1 + 1e-9
NONE = np.iinfo(np.int64).min


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, is_query: Column, scale: int) -> DataFrame:
    """(vec_id, is_query, norm, x) of the rows with an id and a usable vector; x holds floor(scale * component), packed."""
    T.bound_batches(df.sparkSession)
    rows = df.select(
        F.col(id_col).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("is_query"),
        F.col(vector_col).cast("array<double>").alias("v"),
    ).filter("vec_id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sizes, values = V.usable(batch.column("v"))
            x = V.scaled(values, scale)
            ends = np.cumsum(sizes)
            raw = [V.packed(x[e - s : e]) for e, s in zip(ends, sizes)]
            square = np.concatenate(([0.0], np.cumsum(x.astype(np.float64) ** 2)))
            # few large numbers must not blur the others' lengths: those that could are summed by themselves
            norm = np.sqrt(square[ends] - square[ends - sizes])
            for i in np.flatnonzero(np.full(len(at), square[-1] > 2.0**52)):
                norm[i] = np.sqrt((x[ends[i] - sizes[i] : ends[i]].astype(np.float64) ** 2).sum())
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(take), batch.column("is_query").take(take), pa.array(norm), pa.array(raw, pa.binary())],
                names=["vec_id", "is_query", "norm", "x"],
            )

    return rows.mapInArrow(run, "vec_id long, is_query boolean, norm double, x binary")


def bucketed(vectors: DataFrame, parts: int) -> DataFrame:
    """(part, no, n, top, low, ids, norms, xs): buckets, longest first; ``part`` and ``no`` follow the order of length."""
    placed = vectors.select("vec_id", "norm", "x").repartitionByRange(parts, F.desc("norm"), "vec_id")
    placed = placed.sortWithinPartitions(F.desc("norm"), "vec_id").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = 0
        for batch in batches:
            for at in range(0, batch.num_rows, BUCKET):
                some = batch.slice(at, BUCKET)
                x = V.stacked(some.column("x").to_pylist())
                norms = np.asarray(some.column("norm"))
                ids = np.asarray(some.column("vec_id"))
                row = [some.column("part")[0].as_py(), no, len(ids), norms.max(), ids.tobytes(), norms.tobytes(), V.packed(x), x.shape[1]]
                no += 1
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=["part", "no", "n", "top", "ids", "norms", "xs", "width"])

    return placed.mapInArrow(run, "part int, no int, n int, top double, ids binary, norms binary, xs binary, width int")


class Bucket:
    def __init__(self, ids: bytes, norms: bytes, xs: bytes, width: int):
        self.ids, self.norms = np.frombuffer(ids, np.int64), np.frombuffer(norms, np.float64)
        self.x = V.unpacked(xs).reshape(len(self.ids), width)
        self.top = float(self.norms.max())
        self.most = int(np.abs(self.x).max(initial=0))
        self._sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def by_coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """(order, values) of a coordinate of the vectors brought to length one."""
        if f not in self._sorted:
            unit = self.x[:, f] / np.maximum(self.norms, 1e-300)
            order = np.argsort(unit, kind="stable")
            self._sorted[f] = order, unit[order]
        return self._sorted[f]


def products(q: np.ndarray, p: np.ndarray, most: int) -> np.ndarray:
    """Exact inner products of integer rows; ``most`` bounds the absolute sum."""
    if most < 1 << 24:
        return q.astype(np.float32) @ p.astype(np.float32).T
    if most < 1 << 53:
        return q.astype(np.float64) @ p.astype(np.float64).T
    if most < 1 << 63:
        return q.astype(np.int64) @ p.astype(np.int64).T
    raise OverflowError("an inner product exceeds a long")


class Searcher:
    """The best k of the buckets seen so far for each query of a block."""

    def __init__(self, ids: np.ndarray, norms: np.ndarray, x: np.ndarray, bound: np.ndarray, k: int):
        self.ids, self.norms, self.x, self.k = ids, norms, x, k
        self.bound = bound.astype(np.float64).copy()  # a score that k others reach, or minus infinity
        self.most = int(np.abs(x).max(initial=0))
        self.scores = np.full((len(ids), k), NONE)
        self.found = np.zeros((len(ids), k), np.int64)

    def look(self, b: Bucket) -> None:
        width = max(self.x.shape[1], b.x.shape[1])
        x, p = V.widened(self.x, width), V.widened(b.x, width)
        most = self.most * b.most * max(width, 1)
        live = np.flatnonzero(~(self.bound > self.norms * b.top * SLACK))
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(self.bound[live] > 0, self.bound[live] / (self.norms[live] * b.top), -1.0)
        high = cosine >= COSINE
        self._by_coordinate(live[high], np.minimum(cosine[high] / SLACK, 1.0), b, x, p, most)
        low = live[~high]
        for at in range(0, len(low), TILE):
            self._by_length(low[at : at + TILE], b, x, p, most)

    def _by_length(self, rows: np.ndarray, b: Bucket, x: np.ndarray, p: np.ndarray, most: int) -> None:
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(self.bound[rows] > 0, self.bound[rows] / self.norms[rows], 0.0).min()
        front = int(np.count_nonzero(b.norms * SLACK >= need))
        score = products(x[rows], p[:front], most)
        hit = score >= self.bound[rows][:, None]
        many = np.flatnonzero(hit.sum(axis=1) > 4 * self.k)
        if len(many) and front > self.k + 1:
            # one more than k, since the query's own row may be among them
            hit[many] &= score[many] >= np.partition(score[many], front - self.k - 1, axis=1)[:, [front - self.k - 1]]
        r, c = np.nonzero(hit)
        self._merge(rows[r], score[r, c].astype(np.int64), b.ids[c])

    def _by_coordinate(self, rows: np.ndarray, cosine: np.ndarray, b: Bucket, x: np.ndarray, p: np.ndarray, most: int) -> None:
        if not len(rows):
            return
        if most >= 1 << 63:
            raise OverflowError("an inner product exceeds a long")
        unit = x[rows] / self.norms[rows][:, None]
        width = min(FOCUS, b.x.shape[1])
        focus = np.argsort(-np.abs(unit[:, : b.x.shape[1]]), axis=1)[:, :width]
        best = np.full(len(rows), len(b.ids) + 1)
        start, where = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for j in range(width):
            value = np.clip(unit[np.arange(len(rows)), focus[:, j]], -1, 1)
            angle, room = np.arccos(value), np.arccos(cosine)
            low, high = np.cos(np.minimum(angle + room, np.pi)) - 1e-9, np.cos(np.maximum(angle - room, 0)) + 1e-9
            for f in np.unique(focus[:, j]):
                at = np.flatnonzero(focus[:, j] == f)
                _, values = b.by_coordinate(int(f))
                a, z = np.searchsorted(values, low[at], "left"), np.searchsorted(values, high[at], "right")
                less = z - a < best[at]
                best[at[less]], start[at[less]], where[at[less]] = (z - a)[less], a[less], f
        for at in range(0, len(rows), TILE):  # TILE * BUCKET pairs at most
            some = slice(at, at + TILE)
            n = best[some]
            r = np.repeat(np.arange(len(n)), n)
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + start[some][r]
            c = np.zeros(len(r), np.int64)
            for f in np.unique(where[some]):
                of = where[some][r] == f
                c[of] = b.by_coordinate(int(f))[0][place[of]]
            for part in range(0, len(r), 1 << 16):
                rr, cc = rows[some][r[part : part + (1 << 16)]], c[part : part + (1 << 16)]
                score = np.einsum("ij,ij->i", x[rr].astype(np.int64), p[cc].astype(np.int64))
                hit = score >= self.bound[rr]
                self._merge(rr[hit], score[hit], b.ids[cc[hit]])

    def _merge(self, row: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        other = vec != self.ids[row]
        row, score, vec = row[other], score[other], vec[other]
        if not len(row):
            return
        hit = np.unique(row)
        held = np.repeat(hit, self.k)
        row = np.concatenate((held, row))
        score = np.concatenate((self.scores[hit].ravel(), score))
        vec = np.concatenate((self.found[hit].ravel(), vec))
        real = score != NONE
        row, score, vec = row[real], score[real], vec[real]
        order = np.lexsort((vec, -score, row))
        row, score, vec = row[order], score[order], vec[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        top = rank < self.k
        row, rank, score, vec = row[top], rank[top], score[top], vec[top]
        self.scores[hit] = NONE
        self.scores[row, rank], self.found[row, rank] = score, vec
        full = self.scores[hit, self.k - 1]
        self.bound[hit] = np.where(full != NONE, np.maximum(self.bound[hit], full), self.bound[hit])

    def result(self) -> pa.RecordBatch:
        r, c = np.nonzero(self.scores != NONE)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[r]), pa.array(self.found[r, c]), pa.array(self.scores[r, c])], names=["query_id", "vec_id", "score"]
        )


def top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` marks, the k rows of other ids with the highest score.

    The score is the inner product of floor(scale * component), as long; equal scores go by the smaller id, and a query with
    fewer other rows gets them all. Rows with a null id, a null vector or a null or non-finite component take no part.
    Vectors of different lengths count as filled up with zeros (an empty one scores 0). Of rows that repeat an id each is a
    candidate of its own, as a query the id counts once, with its smallest vector. An empty table gives none. A product that
    exceeds a long raises an error. Jobs that run while the query is built give counts and bounds of blocks, one number per
    ``BLOCK`` rows, and the ``BUCKET`` longest vectors; those are broadcast.
    """
    spark = df.sparkSession
    vectors = written(integer_vectors(df, id_col, vector_col, is_query, scale), "vectors")
    n = vectors.count()
    blocks, parts = max(16, -(-n // BLOCK)), max(16, -(-n // BLOCK))
    buckets = written(bucketed(vectors, parts), "buckets")
    last = (buckets.agg(F.max("part")).first()[0] or 0) + 1
    buckets = buckets.withColumn("block", F.floor(F.col("part") * blocks / last).cast("int"))
    tops = dict(buckets.groupBy("block").agg(F.max("top")).collect())
    longest = np.array([tops.get(b, 0.0) for b in range(blocks)])
    longest = np.maximum.accumulate(longest[::-1])[::-1]  # falls from block to block
    seed = buckets.orderBy("part", "no").limit(1).collect()
    sent = spark.sparkContext.broadcast((longest, [(bytes(s["ids"]), bytes(s["norms"]), bytes(s["xs"]), s["width"]) for s in seed]))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, first = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, norms, x = np.asarray(batch.column("vec_id")), np.asarray(batch.column("norm")), V.stacked(batch.column("x").to_pylist())
            s = Searcher(ids, norms, x, np.full(len(ids), -np.inf), k)
            for f in first:
                s.look(Bucket(*f))
            reach = np.array([np.count_nonzero(~(o > m * tops * SLACK)) for o, m in zip(s.bound, norms)], np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("norm"), batch.column("x"), pa.array(s.bound), pa.array(reach)], names=["vec_id", "norm", "x", "bound", "reach"]
            )

    asked = vectors.filter("is_query").groupBy("vec_id").agg(F.min(F.struct("norm", "x")).alias("v")).select("vec_id", "v.norm", "v.x")
    asked = written(asked.mapInArrow(begin, "vec_id long, norm double, x binary, bound double, reach int"), "queries")
    q_blocks = max(1, -(-asked.count() // QUERIES))
    placed = asked.repartitionByRange(q_blocks, F.desc("reach"), "vec_id").withColumn("part", F.spark_partition_id())

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BUCKET):
                some = batch.slice(at, BUCKET)
                x = V.stacked(some.column("x").to_pylist())
                row = [some.column("part")[0].as_py(), int(np.asarray(some.column("reach")).max()), *[np.asarray(some.column(c)).tobytes() for c in ("vec_id", "norm", "bound")], V.packed(x), x.shape[1]]
                kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=["part", "reach", "ids", "norms", "bounds", "xs", "width"])

    packs = written(placed.mapInArrow(gather, "part int, reach int, ids binary, norms binary, bounds binary, xs binary, width int"), "query_blocks")
    q_last = (packs.agg(F.max("part")).first()[0] or 0) + 1
    packs = packs.withColumn("q", F.floor(F.col("part") * q_blocks / q_last).cast("int"))
    reach = dict(packs.groupBy("q").agg(F.max("reach")).collect())
    none = F.lit(None).cast("binary")
    ask = packs.select("q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(-1).alias("part"), F.lit(0).alias("no"), "ids", "norms", "bounds", "xs", "width", "reach")
    ask = ask.filter("block < reach").drop("reach")
    wanted = F.array(*[F.lit(int(reach.get(q, 0))) for q in range(q_blocks)])
    meet = buckets.select(F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q"), "block", "part", "no", "ids", "norms", none.alias("bounds"), "xs", "width")
    meet = meet.filter(F.col("block") < F.element_at(wanted, F.col("q") + 1))
    cells = ask.unionByName(meet).withColumn("cell", F.col("q") * blocks + F.col("block"))
    cells = cells.repartition(blocks * q_blocks, "cell").sortWithinPartitions("cell", "part", "no")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, state, waiting = None, None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("cell", "part", "ids", "norms", "bounds", "xs", "width")}
                if row["cell"] != cell:
                    if state is not None:
                        yield state.result()
                    cell, state, waiting = row["cell"], None, []
                if row["part"] < 0:
                    waiting.append(row)
                    continue
                if state is None:
                    width = max(w["width"] for w in waiting)
                    x = np.concatenate([V.widened(V.unpacked(w["xs"]).reshape(-1, w["width"]) if w["width"] else np.zeros((len(w["ids"]) // 8, 0), np.int16), width) for w in waiting])
                    whole = [np.concatenate([np.frombuffer(w[c], t) for w in waiting]) for c, t in (("ids", np.int64), ("norms", np.float64), ("bounds", np.float64))]
                    state, waiting = Searcher(whole[0], whole[1], x, whole[2], k), []
                state.look(Bucket(row["ids"], row["norms"], row["xs"], row["width"]))
        if state is not None:
            yield state.result()

    best = cells.mapInArrow(scan, "query_id long, vec_id long, score long")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
