"""Language-model scores from a weighted backoff automaton.

The model is a bigram automaton: one state per training token (and one for the start of a text) over a root. An arc carries
the smoothed log-probability of a token after a state; where a state has no arc for a token, its failure arc leads to the
root and adds the backoff weight. Probabilities are interpolated absolute discounting,

    p(w | h) = max(c(hw) - D2, 0) / c(h) + D2 * T(h) / c(h) * p(w),    p(w) = (c(w) - D1) / N,  D1 * V / N for unknown words,

with c the training counts, T(h) the number of distinct tokens after h, and D = n1 / (n1 + 2 * n2) from the numbers of
n-grams seen once and twice. An unknown state is the root.

The automaton grows with the corpus and is never gathered. Texts are dealt into blocks; a block asks for the states and
arcs that its texts can reach, hash buckets add up the counts of all blocks, and the answers give each block its part of the
automaton, over which its texts are walked once, left to right. Words that follow one state are spread over many buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm import tokens as T

BLOCK_CHARS = 1 << 23
BUCKET_CHARS = 1 << 24
#: Hashes of the marks before and after a text.
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
#: What travels between blocks and buckets. Levels: 1 tokens asked for, 2 arcs asked for, 3 counts of arcs, 4 arcs per state,
#: 5 arcs seen once and twice, 6 counts of tokens, 7 totals.
_ROW = "target int, level int, block int, bucket int, a binary, b binary, c binary, d binary, stats array<long>"
_NAMES = ["target", "level", "block", "bucket", "a", "b", "c", "d", "stats"]


def _row_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    return pa.table([pa.array([r[i] if i < len(r) else None for r in rows], k) for i, k in enumerate(kinds)], names=_NAMES)


def _planes(x: np.ndarray, n: int) -> bytes:
    """The n low bytes of each value as byte planes, high bytes first; sorted values compress well this way."""
    return np.ascontiguousarray(x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - n :].T).tobytes()


def _from_planes(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(n, -1)
    full = np.zeros((planes.shape[1], 8), np.uint8)
    full[:, 8 - n :] = planes.T
    return full.view(">u8").ravel().astype(np.uint64)


def _small(x: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as compressed bytes, and those of 255 or more in full."""
    low = np.minimum(x, 255).astype(np.uint8).tobytes()
    return pa.compress(low, codec="zstd", asbytes=True), x[x >= 255].astype(np.int64).tobytes()


def _from_small(low: bytes, high: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(pa.decompress(low, n, codec="zstd"), np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(high, np.int64)
    return out


def _scaled(x: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (((x >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


@dataclass
class Block:
    """Tokens of a block's texts: distinct tokens and arcs, in an order that depends only on which tokens there are."""

    token: np.ndarray  # place in ``keys`` of every token, text by text, each text closed by the end mark
    text_of: np.ndarray
    keys: np.ndarray  # distinct hashes, sorted, both marks among them
    state: np.ndarray  # place in ``keys`` of the state before every token
    arc: np.ndarray  # place of every (state, token) in the arcs
    arc_state: np.ndarray
    arc_token: np.ndarray


def block_of(f: T.Flat) -> Block:
    low = T.lowered(f)
    starts, ends, text_of = T.word_spans(low)
    words = T.span_hashes(low.buf, starts, ends)
    n_words = np.bincount(text_of, minlength=len(f))
    close = np.cumsum(n_words)
    hashes = np.insert(words, close, END)
    owner = np.insert(text_of, close, np.arange(len(f)))
    keys, place = np.unique(np.concatenate((hashes, [START, END])), return_inverse=True)
    token, mark = place[: len(hashes)], place[len(hashes)]
    state = np.concatenate(([mark], token[:-1])) if len(token) else token
    state[np.concatenate(([True], owner[1:] != owner[:-1])) if len(owner) else slice(0)] = mark
    pairs, arc = np.unique(state * np.int64(len(keys)) + token, return_inverse=True)
    return Block(token, owner, keys, state, arc, pairs // len(keys), pairs % len(keys))


@dataclass(frozen=True)
class Layout:
    """Where counts live: arcs in ``arcs`` buckets, tokens in ``words`` buckets behind them."""

    arcs: int
    words: int
    spread: int  # buckets that share the arcs of one state

    def arc_bucket(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            side = T.mix64(token ^ np.uint64(0xA4093822299F31D0)) % np.uint64(self.spread)
            return (_scaled(T.mix64(state + np.uint64(1)), self.arcs) + side.astype(np.int64) * (self.arcs // self.spread)) % self.arcs

    def word_bucket(self, key: np.ndarray) -> np.ndarray:
        return _scaled(key, self.words)

    def arc_order(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(arcs by bucket, cuts between the buckets); inside a bucket by state and token."""
        bucket = self.arc_bucket(block.keys[block.arc_state], block.keys[block.arc_token])
        order = np.argsort(bucket, kind="stable")
        return order, np.searchsorted(bucket[order], np.arange(self.arcs + 1))

    def word_cuts(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.word_bucket(keys), np.arange(self.words + 1))


def _unpack(table: pa.Table) -> tuple[T.Flat, np.ndarray]:
    """(texts, whether each is learned from) of the packed rows of a block."""
    data, sizes, learn = [], [], []
    for row in table.select(["texts", "sizes", "learn", "n_bytes"]).to_pylist():
        sizes.append(np.frombuffer(row["sizes"], np.int64))
        learn.append(np.frombuffer(row["learn"], bool))
        data.append(np.frombuffer(pa.decompress(row["texts"], row["n_bytes"], codec="zstd"), np.uint8))
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    offsets = np.concatenate(([0], np.cumsum(size)))
    return T.Flat(np.concatenate(data) if data else np.zeros(0, np.uint8), offsets), np.concatenate(learn) if learn else np.zeros(0, bool)


def _asked(layout: Layout):
    """Packed texts of a block -> its tokens and arcs with their training counts, one row per bucket."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        number = key[0].as_py()
        f, learn = _unpack(table)
        block = block_of(f)
        learned = learn[block.text_of]
        words = np.bincount(block.token[learned], minlength=len(block.keys))
        words[np.searchsorted(block.keys, START)] = learn.sum()
        arcs = np.bincount(block.arc[learned], minlength=len(block.arc_state))
        rows = []
        order, cuts = layout.arc_order(block)
        state, token, count = block.arc_state[order], block.keys[block.arc_token[order]], arcs[order]
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            part = slice(cuts[b], cuts[b + 1])
            states, n = np.unique(state[part], return_counts=True)
            low, high = _small(count[part])
            head = _planes(block.keys[states], 8) + pa.compress(n.astype(np.uint32).tobytes(), codec="zstd", asbytes=True)
            rows.append((b, 2, number, b, head, _planes(T.mix64(token[part]), 5), low, high, [len(states)]))
        cuts = layout.word_cuts(block.keys)
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            part = slice(cuts[b], cuts[b + 1])
            rows.append((layout.arcs + b, 1, number, b, _planes(block.keys[part], 8), None, *_small(words[part])))
        return _row_table(rows)

    return run


def _add_arcs(layout: Layout):
    """An arc bucket of all blocks -> the count of every arc asked for, and the number of arcs of every state in it.

    Rows of word buckets pass through.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() >= layout.arcs:
            return table.select(_NAMES)
        rows = table.to_pylist()
        states, tokens, counts, sizes = [], [], [], []
        for r in rows:
            tokens.append(_from_planes(r["b"], 5))
            counts.append(_from_small(r["c"], r["d"], len(tokens[-1])))
            n = r["stats"][0]
            each = np.frombuffer(pa.decompress(r["a"][8 * n :], 4 * n, codec="zstd"), np.uint32)
            states.append(np.repeat(_from_planes(r["a"][: 8 * n], 8), each))
            sizes.append(len(tokens[-1]))
        state, token, count = np.concatenate(states), np.concatenate(tokens), np.concatenate(counts)
        order = np.lexsort((token, state))
        s, t = state[order], token[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
        start = np.flatnonzero(new)
        total = np.add.reduceat(count[order], start)
        answer = np.empty(len(s), np.int64)
        answer[order] = np.repeat(total, np.diff(np.append(start, len(s))))
        out, at = [], 0
        for r, size in zip(rows, sizes):
            # to the block, by way of any word bucket
            out.append((layout.arcs + r["block"] % layout.words, 3, r["block"], r["bucket"], *_small(answer[at : at + size]), None, None))
            at += size
        known = s[start][total > 0]
        own, n = np.unique(known, return_counts=True)
        cuts = layout.word_cuts(own)
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            part = slice(cuts[b], cuts[b + 1])
            out.append((layout.arcs + b, 4, -1, b, _planes(own[part], 8), None, *_small(n[part])))
        seen = [int(np.count_nonzero(total == n)) for n in (1, 2)]
        out.append((layout.arcs + key[0].as_py() % layout.words, 5, -1, -1, None, None, None, None, seen))
        return _row_table(out)

    return run


def _keyed(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of a row of level 1 or 4."""
    keys = _from_planes(row["a"], 8)
    return keys, _from_small(row["c"], row["d"], len(keys))


def _add_words(key: tuple, table: pa.Table) -> pa.Table:
    """A word bucket of all blocks -> count and number of following tokens of every token asked for, and totals.

    Answers go to the block; totals are N, V, n1, n2 of the tokens and n1, n2 of the arcs.
    """
    by: dict[int, list[dict]] = {}
    for r in table.to_pylist():
        by.setdefault(r["level"], []).append(r)
    out = [(r["block"], 3, r["block"], r["bucket"], r["a"], r["b"], None, None) for r in by.get(3, ())]
    totals = np.zeros(6, np.int64)
    for r in by.get(5, ()):
        totals[4:] += r["stats"]
    asked = [(r, *_keyed(r)) for r in by.get(1, ())]
    if asked:
        keys, place = np.unique(np.concatenate([k for _, k, _ in asked]), return_inverse=True)
        count = np.zeros(len(keys), np.int64)
        np.add.at(count, place, np.concatenate([c for _, _, c in asked]))
        follow = np.zeros(len(keys), np.int64)
        for r in by.get(4, ()):
            states, n = _keyed(r)
            np.add.at(follow, np.searchsorted(keys, states), n)
        at = 0
        for r, k, _ in asked:
            own = place[at : at + len(k)]
            at += len(k)
            out.append((r["block"], 6, r["block"], r["bucket"], *_small(count[own]), *_small(follow[own])))
        word = count[keys != START]
        totals[:4] = word.sum(), np.count_nonzero(word), np.count_nonzero(word == 1), np.count_nonzero(word == 2)
    out.append((-1, 7, -1, -1, None, None, None, None, totals.tolist()))
    return _row_table(out)


def _discount(once: int, twice: int) -> float:
    return min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.5


class Automaton:
    """The part of the automaton that a block's texts reach."""

    def __init__(self, block: Block, count: np.ndarray, follow: np.ndarray, arcs: np.ndarray, totals: np.ndarray):
        self.block, self.count = block, count
        self.n, self.v, once, twice, arc_once, arc_twice = (int(x) for x in totals)
        d1, d2 = _discount(once, twice), _discount(arc_once, arc_twice)
        self.unknown = d1 * self.v / self.n if self.n else 1.0
        root = np.where(count > 0, (count - d1) / max(self.n, 1), self.unknown)
        states = np.maximum(count, 1)
        back = np.where(count > 0, d2 * follow / states, 1.0)
        straight = np.maximum(arcs - d2, 0) / states[block.arc_state]
        #: log10 of a token at the root, of a failure arc, and of an arc (where there is one).
        self.root = np.log10(root)
        with np.errstate(divide="ignore"):
            self.failure = np.log10(back)
        self.has_arc = arcs > 0
        self.weight = np.log10(np.where(self.has_arc, straight + back[block.arc_state] * root[block.arc_token], 1.0))

    def walk(self, n_texts: int) -> dict[str, np.ndarray]:
        """Every text once, left to right: take the arc, or fail to the root and take its arc; sums per text."""
        b = self.block
        step = np.where(self.has_arc[b.arc], self.weight[b.arc], self.failure[b.state] + self.root[b.token])
        base = np.log10(self.count + 1) - np.log10(self.n + self.v + 1)
        return {
            "n_tokens": np.bincount(b.text_of, minlength=n_texts),
            "n_known": np.bincount(b.text_of[self.count[b.token] > 0], minlength=n_texts),
            "base_score": np.bincount(b.text_of, base[b.token], n_texts),
            "score": np.bincount(b.text_of, step, n_texts),
        }


def _answered(layout: Layout, names: list[str]):
    """Packed texts of a block and the answers to it -> the scores of its texts."""

    def run(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        f, learn = _unpack(texts)
        block = block_of(f)
        count, follow = np.zeros(len(block.keys), np.int64), np.zeros(len(block.keys), np.int64)
        arcs = np.zeros(len(block.arc_state), np.int64)
        order, arc_cuts = layout.arc_order(block)
        word_cuts = layout.word_cuts(block.keys)
        totals = np.zeros(6, np.int64)
        for r in answers.to_pylist():
            if r["level"] == 7:
                totals = np.array(r["stats"])
            elif r["level"] == 6:
                part = slice(word_cuts[r["bucket"]], word_cuts[r["bucket"] + 1])
                n = part.stop - part.start
                count[part], follow[part] = _from_small(r["a"], r["b"], n), _from_small(r["c"], r["d"], n)
            else:
                own = order[arc_cuts[r["bucket"]] : arc_cuts[r["bucket"] + 1]]
                arcs[own] = _from_small(r["a"], r["b"], len(own))
        got = Automaton(block, count, follow, arcs, totals).walk(len(f))
        ids = texts.column("ids").combine_chunks().flatten()
        n = np.full(len(f), totals[0])
        return pa.table(
            [ids, pa.array(learn), *(pa.array(got[c].astype(np.int64)) for c in ("n_tokens", "n_known")), pa.array(n),
             pa.array(got["base_score"].astype(float)), pa.array(got["score"].astype(float))], names=names,
        )

    return run


def _packed(rows: DataFrame, kind: str) -> DataFrame:
    """Rows (doc_id, text, learn, block) as one row per batch and block, texts compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=5)
        for batch in T.pieces(batches):
            number = batch.column("block").to_numpy()
            order = np.argsort(number, kind="stable")
            taken = batch.take(pa.array(order))
            f, number = T.flat(taken.column("text")), number[order]
            learn = taken.column("learn").to_numpy(zero_copy_only=False)
            cuts = np.append(np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1]))), len(number))
            out = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                raw = f.buf[f.offsets[a] : f.offsets[b]].tobytes()
                out.append((int(number[a]), codec.compress(raw, asbytes=True), len(raw), np.diff(f.offsets[a : b + 1]).tobytes(), learn[a:b].tobytes()))
            ids = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), taken.column("doc_id"))
            kinds = [pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)), ids], names=["block", "texts", "n_bytes", "sizes", "learn", "ids"]
            )

    return rows.mapInArrow(run, f"block int, texts binary, n_bytes long, sizes binary, learn binary, ids array<{kind}>")


def score_texts(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, learned, n_tokens, n_known, train_tokens, base_score, score) of every row; logarithms to base 10.

    The model learns from the rows where ``learn`` holds (a null doesn't). Words are runs of characters other than space
    and 9..13, A-Z lower-cased; every text closes with an end token, so null and empty texts have that one. Repeated rows
    are learned from and scored each. Without a row to learn from every token is unknown with probability 1.
    """
    T.bound_batches(df.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    kind = dict(rows.dtypes)["doc_id"]
    chars = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks, buckets = max(64, chars // BLOCK_CHARS), max(64, chars // BUCKET_CHARS)
    layout = Layout(buckets, max(32, buckets // 4), max(4, buckets // 16))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    packed = _packed(dealt, kind)
    asked = packed.groupBy("block").applyInArrow(_asked(layout), _ROW)
    arcs = asked.groupBy("target").applyInArrow(_add_arcs(layout), _ROW)
    words = arcs.groupBy("target").applyInArrow(_add_words, _ROW)
    sums = words.filter("level = 7").agg(F.array(*[F.sum(F.get("stats", F.lit(i))) for i in range(6)]).alias("stats"))
    totals = sums.filter(F.get("stats", F.lit(0)).isNotNull()).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "stats").select(
        F.lit(7).alias("level"), F.col("block").cast("int").alias("block"), F.lit(-1).alias("bucket"), *[F.lit(None).cast("binary").alias(c) for c in "abcd"], "stats"
    )
    answers = words.filter("level <> 7").select("level", "block", "bucket", "a", "b", "c", "d", "stats").unionByName(totals)
    names = ["doc_id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = f"doc_id {kind}, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_answered(layout, names), schema)
