"""SentencePiece encoding as a max-plus scan over chunks, and decoding.

The best segmentation of a text maximises the sum of its pieces' scores. A text is cut into chunks at fixed places; the
state at a cut is how many characters the piece that crosses it reaches into the next chunk. A chunk's transfer matrix
holds the best score from each entering to each leaving state. Matrices are multiplied (max, +) in blocks and the blocks
along the text, which gives the scores entering every chunk; maps from leaving to entering state are composed back the
same way; then every chunk is traced back by itself. A text of one chunk is its own scan.

Words are solved once per task: where no piece runs across a place (before a space that follows another character), every
path passes it, so the matrix of a chunk is its first and last segment around a sum of known words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm import piece_words as W
from flowspark.llm import tokens as T
from flowspark.llm.salted import salted_join
from flowspark.llm.shared import written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Characters per chunk.
CHUNK = 1 << 15
#: Chunks per block of the scan.
BLOCK = 64
NEVER = float("-inf")
#: Words whose cut a worker process remembers.
_CACHE = 50_000
#: Bytes of text whose words are solved together.
WORD_BYTES = 2 << 20


@dataclass(frozen=True)
class Pieces:
    """What encoding needs of a model: surfaces with scores, byte pieces, and the id for what nothing covers."""

    surfaces: tuple[str, ...]
    scores: tuple[float, ...]
    ids: tuple[int, ...]
    bytes_: tuple[int, ...]
    unknown: int
    surface_of: tuple[bytes, ...]

    def plain(self) -> tuple:
        return (self.surfaces, self.scores, self.ids, self.bytes_, self.unknown, self.surface_of)


def load(path: str = MODEL) -> Pieces:
    """Read a model file on the driver. Its normaliser must only mark spaces (with one in front); else this raises."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    if sp.normalize("ａ fi  x ") != f"{SPACE}ａ{SPACE}fi{SPACE}{SPACE}x{SPACE}":
        raise ValueError("the model's normaliser does more than mark spaces")
    surfaces, scores, ids, byte_ids, surface_of = [], [], [], {}, []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:-1], 16)] = i
            surface_of.append(bytes([int(piece[3:-1], 16)]))
        elif sp.is_control(i) or sp.is_unused(i) or sp.is_unknown(i):
            surface_of.append(" ⁇ ".encode() if sp.is_unknown(i) else b"")
        else:
            surfaces.append(piece)
            scores.append(sp.get_score(i))
            ids.append(i)
            surface_of.append(piece.replace(SPACE, " ").encode())
    fallback = tuple(byte_ids[b] for b in range(256)) if len(byte_ids) == 256 else ()
    return Pieces(tuple(surfaces), tuple(scores), tuple(ids), fallback, sp.unk_id(), tuple(surface_of))


def marked(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


class Lattice:
    """Best paths through the pieces of marked text. Of equal paths the one whose last piece is longest wins, at every place."""

    def __init__(self, pieces: Pieces):
        self._nodes: dict[str, tuple[float, int] | None] = {}
        self.unknown = min(pieces.scores, default=0.0) - 10
        self.bytes_, self.unknown_id = pieces.bytes_, pieces.unknown
        self.surfaces, self.scores, self.ids = pieces.surfaces, np.append(pieces.scores, NEVER), np.append(pieces.ids, -1)
        self.table: W.PieceTable | None = None
        self.longest = max(map(len, pieces.surfaces), default=1)
        joined = any(SPACE in s.lstrip(SPACE) for s in pieces.surfaces)
        self.joined = joined
        self.alone = alone = "".join(c for c in "\n\t\r" if not any(c in s for s in pieces.surfaces))
        if joined:
            self.segment = re.compile(r"[\s\S]+")
        elif alone:
            self.segment = re.compile(f"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+")
        else:
            self.segment = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.cut = None if joined else re.compile(f"(?<=[^{SPACE}])(?={SPACE})")
        self.known: dict[str, tuple[float, tuple[int, ...]]] = {}

    @property
    def nodes(self) -> dict[str, tuple[float, int] | None]:
        """All prefixes of pieces; made where a giant or a long word needs them."""
        if not self._nodes:
            for surface, score, i in zip(self.surfaces, self.scores.tolist(), self.ids.tolist()):
                for n in range(1, len(surface)):
                    self._nodes.setdefault(surface[:n], None)
                self._nodes[surface] = (score, i)
        return self._nodes

    def _ids(self, piece: str, i: int) -> tuple[int, ...]:
        if i >= 0:
            return (i,)
        return tuple(self.bytes_[b] for b in piece.encode()) if self.bytes_ else (self.unknown_id,)

    def forward(self, s: str, n: int, entries: list[tuple[int, float]]) -> tuple[list[float], list[tuple[int, int] | None]]:
        """Best score of every place and the last piece (start, id) that reaches it; pieces start before n.

        A piece that entered from before s counts as longer than any that starts in s.
        """
        best: list[float] = [NEVER] * (len(s) + 1)
        last: list[tuple[int, int] | None] = [None] * (len(s) + 1)
        for at, score in entries:
            best[at] = score
        nodes, size = self.nodes, len(s)
        for a in range(n):
            score = best[a]
            if score == NEVER:
                continue
            b, single = a + 1, False
            while b <= size:
                sub = s[a:b]
                if sub not in nodes:
                    break
                found = nodes[sub]
                if found is not None:
                    single |= b == a + 1
                    if score + found[0] > best[b]:
                        best[b], last[b] = score + found[0], (a, found[1])
                b += 1
            if not single and score + self.unknown > best[a + 1]:
                best[a + 1], last[a + 1] = score + self.unknown, (a, -1)
        return best, last

    def back(self, s: str, last: list[tuple[int, int] | None], at: int) -> tuple[int, list[int]]:
        """(entry, ids) of the best path that ends at a place."""
        out: list[tuple[int, ...]] = []
        while last[at] is not None:
            start, i = last[at]
            out.append(self._ids(s[start:at], i))
            at = start
        return at, list(chain.from_iterable(reversed(out)))

    def word(self, segment: str) -> tuple[float, tuple[int, ...]]:
        found = self.known.get(segment)
        if found is None:
            best, last = self.forward(segment, len(segment), [(0, 0.0)])
            found = best[-1], tuple(self.back(segment, last, len(segment))[1])
            if len(self.known) >= _CACHE:
                self.known.clear()
            self.known[segment] = found
        return found

    def encode(self, s: str) -> Iterator[tuple[int, ...]]:
        """Ids of a marked text that is one chunk, segment by segment."""
        known, word = self.known, self.word
        for segment in self.segment.findall(s):
            found = known.get(segment)
            yield (word(segment) if found is None else found)[1]

    def encode_all(self, f: T.Flat) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cuts): the ids of all texts of a batch, each one chunk, and where each text's ids begin."""
        if self.table is None:
            self.table = W.PieceTable(self.surfaces)
        lead = np.flatnonzero((f.buf & 0xC0) == 0x80)
        offsets = f.offsets - np.searchsorted(lead, f.offsets)
        points = np.frombuffer(f.buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        full = np.flatnonzero(np.diff(offsets))
        points = np.insert(points, offsets[full], 32)
        offsets = offsets + np.searchsorted(full, np.arange(len(offsets)))
        points = np.where(points == 32, np.uint32(ord(SPACE)), points)
        if self.joined:
            starts = offsets[:-1][np.diff(offsets) > 0]
        else:
            starts = W.segment_starts(points, offsets[:-1], ord(SPACE), tuple(map(ord, self.alone))) if len(points) else np.zeros(0, np.int64)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        sizes = np.diff(np.append(starts, len(points)))
        # each distinct word once; long ones by themselves, piece by piece
        long = sizes > W.LONGEST
        hashes = W.word_hashes(points, starts, sizes)
        hashes[long] = T.mix64(starts[long].astype(np.uint64) ^ np.uint64(0xA0761D6478BD642F))
        _, chosen, which = np.unique(hashes, return_index=True, return_inverse=True)
        short = np.flatnonzero(~long[chosen])
        pieces, places, words = W.solve(self.table, self.scores, self.unknown, self.longest, points, starts[chosen[short]], sizes[chosen[short]])
        ids = np.where(pieces >= 0, self.ids[pieces], self.unknown_id).astype(np.int32)
        words = short[words]
        if self.bytes_ and (pieces < 0).any():
            bare = np.flatnonzero(pieces < 0)
            raw = [chr(c).encode("utf-8", "replace") for c in points[places[bare]].tolist()]
            times = np.ones(len(ids), np.int64)
            times[bare] = [len(r) for r in raw]
            ids, words = np.repeat(ids, times), np.repeat(words, times)
            at = np.repeat((np.cumsum(times) - times)[bare], times[bare])
            inner = np.arange(len(at)) - np.repeat(np.cumsum(times[bare]) - times[bare], times[bare])
            ids[at + inner] = np.array(self.bytes_, np.int32)[np.frombuffer(b"".join(raw), np.uint8)]
        for w in np.flatnonzero(long[chosen]).tolist():
            a = starts[chosen[w]]
            text = points[a : a + sizes[chosen[w]]].tobytes().decode("utf-32-le")
            found = np.fromiter(self.word(text)[1], np.int32)
            ids, words = np.concatenate((ids, found)), np.concatenate((words, np.full(len(found), w)))
        order = np.argsort(words, kind="stable")
        ids, count = ids[order], np.bincount(words, minlength=len(chosen))
        first = np.cumsum(count) - count
        n = count[which]
        ends = np.cumsum(n)
        out = ids[np.repeat(first[which] - (ends - n), n) + np.arange(ends[-1])]
        cuts = np.append(0, ends)[np.searchsorted(starts, offsets)]
        return out, cuts

    def _parts(self, s: str, n: int) -> tuple[int, int]:
        """First and last place before n that every path passes, or (-1, -1)."""
        if self.cut is None:
            return -1, -1
        places = [m.start() for m in self.cut.finditer(s, 0, n)]
        return (places[0], places[-1]) if places else (-1, -1)

    def _middle(self, s: str) -> float:
        return sum(self.word(x)[0] for x in self.segment.findall(s))

    def matrix(self, s: str, n: int) -> np.ndarray:
        """Transfer matrix of the chunk s[:n]; the rest of s is what its last pieces may reach into."""
        size = self.longest
        out = np.full((size, size), NEVER)
        first, final = self._parts(s, n)
        if first < 0:
            for i in range(min(size, n)):
                best, _ = self.forward(s, n, [(i, 0.0)])
                out[i, : len(s) - n + 1] = best[n:][:size]
            return out
        middle = self._middle(s[first:final])
        tail, _ = self.forward(s[final:], n - final, [(0, 0.0)])
        ends = np.full(size, NEVER)
        ends[: len(s) - n + 1] = tail[n - final :][:size]
        for i in range(min(size, first + 1)):
            head = 0.0 if i == first else self.forward(s[:first], first, [(i, 0.0)])[0][first]
            out[i] = head + middle + ends
        return out

    def solve(self, s: str, n: int, entering: np.ndarray) -> "Solved":
        return Solved(self, s, n, entering)


class Solved:
    """A chunk with the scores that enter it; paths from any leaving state."""

    def __init__(self, lattice: Lattice, s: str, n: int, entering: np.ndarray):
        self.lattice, self.s, self.n = lattice, s, n
        self.first, self.final = lattice._parts(s, n)
        entries = [(i, float(x)) for i, x in enumerate(entering) if x != NEVER]
        if self.first < 0:
            self.best, self.last = lattice.forward(s, n, entries)
        else:
            self.head = s[: self.first]
            self.best, self.last = lattice.forward(self.head, self.first, [e for e in entries if e[0] <= self.first])
            self.end = s[self.final :]
            self.tail, self.tail_last = lattice.forward(self.end, n - self.final, [(0, 0.0)])

    def _reached(self, state: int) -> bool:
        at = self.n + state
        if at > len(self.s):
            return False
        return (self.best[at] if self.first < 0 else self.tail[at - self.final]) != NEVER

    def entries(self, size: int) -> np.ndarray:
        """Entering state of the best path to each leaving state, -1 where there is none."""
        out = np.full(size, -1, np.int32)
        for j in range(size):
            if self._reached(j):
                if self.first < 0:
                    out[j] = self.lattice.back(self.s, self.last, self.n + j)[0]
                else:
                    out[j] = self.lattice.back(self.head, self.last, self.first)[0]
        return out

    def ids(self, state: int) -> list[int]:
        if self.first < 0:
            return self.lattice.back(self.s, self.last, self.n + state)[1]
        head = self.lattice.back(self.head, self.last, self.first)[1]
        middle = chain.from_iterable(self.lattice.encode(self.s[self.first : self.final]))
        return [*head, *middle, *self.lattice.back(self.end, self.tail_last, self.n + state - self.final)[1]]


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(a * b)[i, j] = max over k of a[i, k] + b[k, j]; associative."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def enter(scores: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Scores after a chunk, less their largest: only differences matter, and they stay exact along a giant text."""
    out = (scores[:, None] + m).max(axis=0)
    return out - out.max()


def cut_text(text: str, size: int, reach: int) -> Iterator[tuple[int, int, str]]:
    """(chunk number, its length, chunk and what follows within reach) of a marked text; the last chunk isn't shorter than reach."""
    n = max(1, len(text) // size)
    for k in range(n):
        stop = len(text) if k == n - 1 else (k + 1) * size
        yield k, stop - k * size, text[k * size : stop + reach]


def _batch(names: list[str], rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


#: The lattice of a worker process; its tasks share it.
_LATTICE: list[tuple[object, Lattice]] = []


def lattice_of(sent) -> Lattice:
    plain = sent.value
    if not _LATTICE or _LATTICE[0][0] is not plain:
        _LATTICE[:] = [(plain, Lattice(Pieces(*plain)))]
    return _LATTICE[0][1]


def _giant_ids(texts: DataFrame, sent, size: int, reach: int) -> DataFrame:
    """(uid, ids) of the distinct texts (uid, text) by the scan over their chunks."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, text in zip(batch.column("uid"), batch.column("text")):
                rows, held = [], 0
                for k, n, s in cut_text(marked(text.as_py()), size, reach):
                    rows.append((uid.as_py(), k, n, s))
                    held += len(s)
                    if held >= T.BATCH_BYTES:
                        yield _batch(["uid", "chunk", "n", "s"], rows, [pa.string(), pa.int32(), pa.int32(), pa.string()])
                        rows, held = [], 0
                if rows:
                    yield _batch(["uid", "chunk", "n", "s"], rows, [pa.string(), pa.int32(), pa.int32(), pa.string()])

    chunks = written(texts.mapInArrow(split, "uid string, chunk int, n int, s string").repartition("uid", "chunk"), "chunks")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(sent)
        for batch in batches:
            got = [lattice.matrix(s.as_py(), n.as_py()).tobytes() for s, n in zip(batch.column("s"), batch.column("n"))]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("chunk"), pa.array(got, pa.binary())], names=["uid", "chunk", "m"])

    matrices = written(chunks.mapInArrow(measure, "uid string, chunk int, m binary"), "matrices")
    block = F.floor(F.col("chunk") / BLOCK).cast("int")

    def matrix(raw: bytes) -> np.ndarray:
        return np.frombuffer(raw).reshape(reach, reach)

    def multiply(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total = None
        for raw in group.sort_values("chunk")["m"]:
            total = matrix(raw) if total is None else max_plus(total, matrix(raw))
        return pd.DataFrame({"uid": [key[0]], "block": [key[1]], "m": [total.tobytes()]})

    def start() -> np.ndarray:
        scores = np.full(reach, NEVER)
        scores[0] = 0.0
        return scores

    def block_starts(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        # a text of 2 GB, Spark's limit, has 1024 blocks
        scores, out = start(), []
        for raw in group.sort_values("block")["m"]:
            out.append(scores.tobytes())
            scores = enter(scores, matrix(raw))
        return pd.DataFrame({"uid": key[0], "block": sorted(group["block"]), "f": out})

    def chunk_starts(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        scores, out = np.frombuffer(group["f"].iloc[0]), []
        for raw in group["m"]:
            out.append(scores.tobytes())
            scores = enter(scores, matrix(raw))
        return pd.DataFrame({"uid": key[0], "chunk": group["chunk"], "f": out})

    blocked = matrices.withColumn("block", block)
    products = blocked.groupBy("uid", "block").applyInPandas(multiply, "uid string, block int, m binary")
    starts = products.groupBy("uid").applyInPandas(block_starts, "uid string, block int, f binary")
    entering = blocked.join(starts, ["uid", "block"]).groupBy("uid", "block").applyInPandas(chunk_starts, "uid string, chunk int, f binary")
    entering = written(entering, "entering")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(sent)
        for batch in batches:
            got = [
                lattice.solve(s.as_py(), n.as_py(), np.frombuffer(f.as_py())).entries(reach).tobytes()
                for s, n, f in zip(batch.column("s"), batch.column("n"), batch.column("f"))
            ]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("chunk"), pa.array(got, pa.binary())], names=["uid", "chunk", "t"])

    solved = chunks.join(entering, ["uid", "chunk"])
    maps = written(solved.mapInArrow(trace, "uid string, chunk int, t binary"), "maps").withColumn("block", block)

    def compose(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total = np.arange(reach, dtype=np.int32)
        for raw in group.sort_values("chunk", ascending=False)["t"]:
            t = np.frombuffer(raw, np.int32)
            total = np.where(total < 0, -1, t[np.maximum(total, 0)]).astype(np.int32)
        return pd.DataFrame({"uid": [key[0]], "block": [key[1]], "t": [total.tobytes()]})

    def block_ends(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group, state, out = group.sort_values("block", ascending=False), 0, []
        for raw in group["t"]:
            out.append(state)
            state = int(np.frombuffer(raw, np.int32)[state])
        return pd.DataFrame({"uid": key[0], "block": group["block"], "leave": out})

    def chunk_ends(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk", ascending=False)
        state, out = int(group["leave"].iloc[0]), []
        for raw in group["t"]:
            out.append(state)
            state = int(np.frombuffer(raw, np.int32)[state])
        return pd.DataFrame({"uid": key[0], "chunk": group["chunk"], "leave": out})

    composed = maps.groupBy("uid", "block").applyInPandas(compose, "uid string, block int, t binary")
    ends = composed.groupBy("uid").applyInPandas(block_ends, "uid string, block int, leave int")
    leaving = maps.join(ends, ["uid", "block"]).groupBy("uid", "block").applyInPandas(chunk_ends, "uid string, chunk int, leave int")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(sent)
        for batch in batches:
            got = [
                lattice.solve(s.as_py(), n.as_py(), np.frombuffer(f.as_py())).ids(j.as_py())
                for s, n, f, j in zip(*(batch.column(c) for c in ("s", "n", "f", "leave")))
            ]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("chunk"), pa.array(got, pa.list_(pa.int32()))], names=["uid", "chunk", "ids"])

    parts = solved.join(leaving, ["uid", "chunk"]).mapInArrow(emit, "uid string, chunk int, ids array<int>")
    ordered = F.sort_array(F.collect_list(F.struct("chunk", "ids")))
    return parts.groupBy("uid").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))


def _spelt(surface: tuple[bytes, ...], ids: list[int]) -> str:
    return b"".join([surface[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")


def encode(
    df: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None, size: int = CHUNK,
) -> DataFrame:
    """(doc_id, extra..., ids) of every row. Null and empty texts have no ids; repeated rows are encoded each.

    Texts of 2 * ``size`` characters or more are cut into chunks (of ``size``, at least the longest piece) and scanned;
    equal ones are scanned once. Characters that no piece covers become byte pieces, or the unknown id without these.
    """
    single, scanned = _encoded(df, pieces, id_col, text_col, extra, size)
    return single.unionByName(scanned)


def _encoded(
    df: DataFrame, pieces: Pieces, id_col: str, text_col: str, extra: dict[str, Column] | None, size: int, spell: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The rows of ``encode`` from texts of one chunk and from scanned ones; with ``spell`` the first also hold the text
    decoded from the ids, made in the same pass, so that no second Python worker stands beside the first."""
    T.bound_batches(df.sparkSession)
    reach = max(map(len, pieces.surfaces), default=1)
    size = max(size, reach)
    sent, extra = df.sparkSession.sparkContext.broadcast(pieces.plain()), extra or {}
    surface = df.sparkSession.sparkContext.broadcast(pieces.surface_of) if spell else None
    carried = list(extra)
    rows = df.select(F.col(id_col).alias("doc_id"), *[c.alias(k) for k, c in extra.items()], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    giant = F.length("text") + 1 >= 2 * size
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(sent)
        for batch in T.pieces(batches, limit=WORD_BYTES):
            ids, cuts = lattice.encode_all(T.flat(batch.column("text")))
            made = {"ids": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids))}
            if spell:
                made["text"] = pa.array([_spelt(surface.value, ids[a:b].tolist()) for a, b in zip(cuts, cuts[1:])], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ["doc_id", *carried]), *made.values()], names=["doc_id", *carried, *made])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in ["doc_id", *carried]), "ids array<int>", *(["text string"] if spell else [])])
    single = rows.filter(~giant).mapInArrow(run, schema)
    large = rows.filter(giant).withColumn("uid", F.sha2("text", 256))
    found = _giant_ids(large.select("uid", "text").dropDuplicates(["uid"]), sent, size, reach)
    whole = salted_join(large.drop("text"), found, ["uid"], F.col("doc_id"), "inner")
    return single, whole.select("doc_id", *carried, "ids")


def decode(df: DataFrame, pieces: Pieces, id_col: str = "doc_id", ids_col: str = "ids", extra: list[str] | None = None) -> DataFrame:
    """(doc_id, extra..., text) from ids; null and empty ids give the empty text, and bytes that are no UTF-8 the mark U+FFFD."""
    T.bound_batches(df.sparkSession)
    sent, carried = df.sparkSession.sparkContext.broadcast(pieces.surface_of), list(extra or [])
    rows = df.select(F.col(id_col).alias("doc_id"), *carried, F.col(ids_col).alias("ids"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surface = sent.value
        for batch in batches:
            texts = [_spelt(surface, ids.as_py() or []) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ["doc_id", *carried]), pa.array(texts, pa.string())], names=["doc_id", *carried, "text"])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in ["doc_id", *carried]), "text string"]))


def round_trip(df: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_digest, text_digest, round_trip): ids and the text decoded from them as digests, and whether
    that text equals the input (null counts as empty)."""
    digest = F.sha1(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    single, scanned = _encoded(df, pieces, id_col, text_col, {"digest": digest}, CHUNK, spell=True)
    counts = ["doc_id", "digest", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_digest")]
    back = decode(scanned.select(*counts, "ids"), pieces, extra=["digest", "n_tokens", "ids_digest"])
    back = single.select(*counts, "text").unionByName(back)
    decoded = F.sha1("text")
    return back.select("doc_id", "n_tokens", "ids_digest", decoded.alias("text_digest"), (decoded == F.col("digest")).alias("round_trip"))
