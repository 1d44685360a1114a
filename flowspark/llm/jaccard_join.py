"""N-gram Jaccard self-join with PartEnum signatures.

Sets whose Jaccard similarity reaches the threshold differ in at most k elements (Hamming distance), where k follows from
the upper end of their size band. The feature domain is hashed into more than k partitions, so similar sets agree in some
whole partition and share the signature of its content. A few partitions more than needed, and those expected to be empty,
are added: similar sets then share at least ``need`` (two or more) signatures of partitions that hold something, and a set
with more empty partitions than foreseen also signs its empty ones. Sets of few elements sign subsets of their elements
instead and need one.

Equal sets are one node. Signatures travel packed, one row per task batch and bucket. Two similar sets agree in all
partitions that one of them fills, but for as many as there are elements in which they may differ. A node that shares fewer
signatures of a band with all others together is left out of that band. Nodes that share much with the best connected node of
a signature are compared with it first, which joins groups of copies in linear work. What is left is compared only across
the components found so far, where two nodes share enough; inside signatures that many nodes share, pairs are formed only
where their sketches allow a link. A sketch holds the parity of the elements per bit, so each bit in which two sketches differ
stands for an element in which the sets differ. Exact verification decides every link, and no candidate is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm import tokens as T
from flowspark.llm.bitmaps import bitmap, held
from flowspark.llm.components import components
from flowspark.llm.salted import salted_join
from flowspark.llm.shared import written

#: Sets up to this size sign subsets of their elements.
SMALL = 14
#: Upper over lower end of a size band.
BAND = 1.5
#: Nodes outside a signature's largest component from which pairs are formed by sketches.
CROWD = 4
#: 64-bit words of the shortest and longest sketches, and elements per word between.
WORDS, MOST_WORDS, PER_WORD = 4, 32, 48
#: Nodes whose sets stand in memory together, twice, while their pairs are verified.
NODES = 1000
#: Band mark of the signatures of small sets.
NO_BAND = 63
#: Characters of text per signature bucket.
BUCKET_CHARS = 1 << 23


def band_table(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(upper end, partitions, foreseen empty partitions, signatures that similar sets share) of the bands above SMALL."""
    upper, parts, empty, need = [], [], [], []
    low = SMALL + 1
    while low < 1 << 33:  # some 50 bands; the number must fit six bits
        high = int(low * BAND)
        k = 2 * high * (100 - percent) // (100 + percent)
        least = low * percent // 100
        sure, spare = 2 + k // 25, 0
        for _ in range(8):
            n = k + sure + spare
            mean = n * (1 - 1 / n) ** least
            spare = min(ceil(mean + 3 * sqrt(mean)), k)
        upper.append(high)
        parts.append(k + sure + spare)
        empty.append(spare)
        need.append(sure)
        low = high + 1
    return np.array(upper), np.array(parts), np.array(empty), np.array(need)


def sketch_words(percent: int) -> np.ndarray:
    """Words of the sketches of each band, a power of two."""
    words = 2 ** np.ceil(np.log2(band_table(percent)[0] / PER_WORD))
    return np.clip(words, WORDS, MOST_WORDS).astype(np.int64)


def sketches(owner: np.ndarray, value: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end, sketch) of sets given as sorted (set, element hash) rows: the parity of the elements at each of ``words`` times 64
    places. The halves of a sketch, one xor the other, are the sketch of half the words."""
    end = np.cumsum(words)
    with np.errstate(over="ignore"):
        place = T.mix64(value ^ np.uint64(0xA0761D6478BD642F))
    word = (place >> np.uint64(6)) & (words[owner] - 1).astype(np.uint64)
    out = np.zeros(end[-1] if len(end) else 0, np.uint64)
    np.bitwise_xor.at(out, (end - words)[owner] + word.astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return end, out


def _least_common(s: int, t: int, percent: int) -> int:
    return -(-percent * (s + t) // (100 + percent))


def small_signatures(value: np.ndarray, percent: int, seed: np.uint64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, signature) of equal-size small sets, a matrix of mixed element hashes: for each partner size the subsets that
    the two must have in common. The lowest bit tells that only sets of different sizes can match."""
    s = value.shape[1]
    total = value.sum(axis=1, dtype=np.uint64)
    for t in range(ceil(s * percent / 100), min(SMALL, s * 100 // percent) + 1):
        common = _least_common(s, t, percent)
        kind = np.uint64((min(s, t) * 64 + max(s, t)) * 64 + common)
        bit = np.uint64(s != t)
        for gone in combinations(range(s), s - common):
            rest = total - value[:, list(gone)].sum(axis=1, dtype=np.uint64) if gone else total
            yield np.arange(len(value)), (T.mix64(rest ^ T.mix64(kind * seed)) & ~np.uint64(127)) | np.uint64(NO_BAND << 1) | bit


def signatures(owner: np.ndarray, value: np.ndarray, n: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, signature) of n sets given as sorted (set, element hash) rows; bits 1 to 6 of a signature tell its band. The
    third result is, per set, the share of the partitions that it fills of its own and the next band, in 255ths, cut."""
    seed = np.uint64(0x9E3779B97F4A7C15)
    size = np.bincount(owner, minlength=n)
    start = np.cumsum(size) - size
    owners, found = [], []
    filled = np.zeros((n, 2), np.uint8)
    with np.errstate(over="ignore"):
        mixed = T.mix64(value + seed)
        for s in range(1, SMALL + 1):
            rows = np.flatnonzero(size == s)
            if len(rows):
                matrix = mixed[start[rows][:, None] + np.arange(s)]
                for at, sig in small_signatures(matrix, percent, seed):
                    owners.append(rows[at])
                    found.append(sig)
        upper, parts, empty, _ = band_table(percent)
        own = np.searchsorted(upper, size)
        # bands of all partners that are at least as large
        last = np.searchsorted(upper, size * 100 // percent)
        reach = size * 100 // percent > SMALL
        band = np.where(size > SMALL, own, 0)
        while True:
            rows = np.flatnonzero(reach & (size > 0) & (band <= last))
            if not len(rows):
                break
            b = band[rows]
            cells = np.cumsum(parts[b]) - parts[b]
            n_cells = int(parts[b].sum())
            index = np.full(n, -1)
            index[rows] = np.arange(len(rows))
            inside = index[owner] >= 0
            at, h = index[owner[inside]], value[inside]
            salt = T.mix64(b.astype(np.uint64) + np.uint64(77))
            part = T.mix64(h ^ salt[at]) % parts[b][at].astype(np.uint64)
            cell = cells[at] + part.astype(np.int64)
            content = np.zeros(n_cells, np.uint64)
            np.add.at(content, cell, mixed[inside])
            full = np.bincount(cell, minlength=n_cells) > 0
            of = np.repeat(np.arange(len(rows)), parts[b])
            place = np.arange(n_cells) - cells[of]
            n_full = np.bincount(of[full], minlength=len(rows))
            n_empty = parts[b] - n_full
            step = b - np.where(size[rows] > SMALL, own[rows], 0)
            known = step < 2  # a share of 0 says nothing of the others
            filled[rows[known], step[known]] = (255 * n_full // parts[b])[known]
            sign = full | (n_empty > empty[b])[of]
            tag = T.mix64(salt[of[sign]] + place[sign].astype(np.uint64) * seed)
            owners.append(rows[of[sign]])
            found.append((T.mix64(content[sign] ^ tag) & ~np.uint64(127)) | (b[of[sign]].astype(np.uint64) << np.uint64(1)))
            band = band + 1
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), filled
    return np.concatenate(owners), np.concatenate(found), filled


def set_keys(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """64-bit key of each set's content."""
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        np.add.at(total, owner, T.mix64(value ^ np.uint64(0x5851F42D4C957F2D)))
        return T.mix64(total + np.bincount(owner, minlength=n).astype(np.uint64))


def document_sets(df: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(doc_id, n_shingles, key) of every row; the key is null for the empty set."""
    rows = T.id_text(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.pieces(batches):
            owner, value = T.shingles(T.flat(batch.column("text")), n)
            size = np.bincount(owner, minlength=batch.num_rows)
            keys = set_keys(owner, value, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(keys, mask=size == 0)], names=["doc_id", "n_shingles", "key"]
            )

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_shingles long, key long")


def _distinct_sets(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, owner, value) of the batch's distinct non-empty sets."""
    owner, value = T.shingles(T.flat(batch.column("text")), n)
    keys = set_keys(owner, value, batch.num_rows)
    size = np.bincount(owner, minlength=batch.num_rows)
    rows = np.flatnonzero(size)
    _, first = np.unique(keys[rows], return_index=True)
    index = np.full(batch.num_rows, -1)
    chosen = np.sort(rows[first])
    index[chosen] = np.arange(len(chosen))
    inside = index[owner] >= 0
    return keys[chosen], index[owner[inside]], value[inside]


def shared_signatures(df: DataFrame, text_col: str, n: int, percent: int) -> DataFrame:
    """(sig, key, size, filled) for every signature of two nodes or more; ``filled`` partitions of the signature's band hold
    elements of the node, or some more."""
    rows = T.id_text(df, text_col, text_col).select("text")
    chars = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    buckets = max(64, chars // BUCKET_CHARS)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.pieces(batches):
            keys, owner, value = _distinct_sets(batch, n)
            size = np.bincount(owner, minlength=len(keys)).astype(np.uint32)
            at, sig, filled = signatures(owner, value, len(keys), percent)
            order = np.argsort(sig)
            at, sig = at[order], sig[order]
            with np.errstate(over="ignore"):
                bucket = ((sig >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            out = []
            for b in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[b], cuts[b + 1])
                used, where = np.unique(at[part], return_inverse=True)
                kind = np.uint16 if len(used) < 1 << 16 else np.uint32
                # big-endian byte planes: the leading bytes of sorted values compress away
                planes = sig[part].astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()
                out.append((int(b), int(part.stop - part.start), planes, where.astype(kind).tobytes(), keys[used].tobytes(), size[used].tobytes(), filled[used].tobytes()))
            if out:
                kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
                names = ["bucket", "n", "sigs", "at", "keys", "sizes", "filled"]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)

    def match(group: pd.DataFrame) -> pd.DataFrame:
        sigs, keys, sizes, shares = [], [], [], []
        upper, parts, _, _ = band_table(percent)
        for n_sigs, planes, at, own, size, filled in zip(*(group[c] for c in ("n", "sigs", "at", "keys", "sizes", "filled"))):
            sigs.append(np.frombuffer(planes, np.uint8).reshape(8, n_sigs).T.copy().view(">u8").ravel().astype(np.uint64))
            where = np.frombuffer(at, np.uint16 if len(at) == 2 * n_sigs else np.uint32)
            keys.append(np.frombuffer(own, np.int64)[where])
            size = np.frombuffer(size, np.uint32)
            sizes.append(size[where])
            home = np.where(size > SMALL, np.searchsorted(upper, size), 0)[where]
            step = ((sigs[-1] >> np.uint64(1)) & np.uint64(63)).astype(np.int64) - home
            share = np.frombuffer(filled, np.uint8).reshape(-1, 2)[where, np.minimum(step, 1)]
            shares.append(np.where(step < 2, share, 0).astype(np.uint8))
        sig, key, size, share = np.concatenate(sigs), np.concatenate(keys), np.concatenate(sizes), np.concatenate(shares)
        order = np.argsort(sig, kind="stable")
        sig, key, size, share = sig[order], key[order], size[order], share[order]
        new = np.concatenate(([True], sig[1:] != sig[:-1]))
        many = np.diff(np.append(np.flatnonzero(new), len(sig))) > 1
        keep = many[np.cumsum(new) - 1]
        sig, key, size, share = sig[keep], key[keep], size[keep], share[keep]
        order = np.lexsort((key, sig))
        sig, key, size, share = sig[order], key[order], size[order], share[order]
        first = np.ones(len(sig), bool)
        first[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
        sig, key, size, share = sig[first], key[first], size[first], share[first]
        start = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.zeros(0, np.int64)
        count = np.diff(np.append(start, len(sig)))
        two = np.repeat(count, count) > 1
        T.give_back()
        band = ((sig >> np.uint64(1)) & np.uint64(63)).astype(np.int64)
        cells = np.where(band < len(parts), parts[np.minimum(band, len(parts) - 1)], 0)
        filled = share.astype(np.int64) * cells // 255
        return pd.DataFrame({"sig": sig.view(np.int64), "key": key, "size": size.astype(np.int64), "filled": filled})[two]

    packed = rows.mapInArrow(sign, "bucket int, n int, sigs binary, at binary, keys binary, sizes binary, filled binary")
    return packed.groupBy("bucket").applyInPandas(match, "sig long, key long, size long, filled long")


def node_sets(df: DataFrame, text_col: str, wanted: DataFrame, n: int, bits: int, percent: int) -> DataFrame:
    """(key, elements, sketch) of the nodes in ``wanted`` (column key): sorted element hashes as bytes, and the sketch for the
    highest band that the node signs.

    A bitmap of fixed size keeps most other sets from being sent; the join after it is exact.
    """
    wanted = wanted.select("key")
    sent = df.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.col("key").alias("v")), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        upper, words = band_table(percent)[0], sketch_words(percent)
        for batch in T.pieces(batches):
            keys, owner, value = _distinct_sets(batch, n)
            cuts = np.searchsorted(owner, np.arange(len(keys) + 1))
            rows = np.flatnonzero(held(known, keys, bits))
            got = [value[cuts[i] : cuts[i + 1]].tobytes() for i in rows]
            index = np.full(len(keys), -1)
            index[rows] = np.arange(len(rows))
            inside = index[owner] >= 0
            last = np.searchsorted(upper, np.diff(cuts)[rows] * 100 // percent)
            end, sketch = sketches(index[owner[inside]], value[inside], words[last])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], end)), pa.int32()), pa.array(sketch.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(keys[rows].view(np.int64)), pa.array(got, pa.binary()), lists], names=["key", "elements", "sketch"])

    sets = T.id_text(df, text_col, text_col).select("text").mapInArrow(run, "key long, elements binary, sketch array<long>")
    return sets.join(wanted, "key", "left_semi").groupBy("key").agg(F.first("elements").alias("elements"), F.first("sketch").alias("sketch"))


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (hub, key) whose sets reach the threshold, compared exactly.

    Nodes are dealt into blocks of about NODES; a pair is compared in the cell of its two blocks, to which each set goes
    once. So a task holds two blocks at most, and a node with many partners isn't sent once for each.
    """
    blocks = max(8, sets.count() // NODES)
    dealt = pairs.select("hub", "key", F.pmod(F.hash("hub"), F.lit(blocks)).alias("x"), F.pmod(F.hash("key"), F.lit(blocks)).alias("y"))
    wanted = dealt.select("x", "y", F.explode(F.array("hub", "key")).alias("key")).distinct()
    none = F.lit(None)
    rows = wanted.join(sets.select("key", "elements"), "key").select("x", "y", none.cast("long").alias("hub"), "key", "elements")
    rows = rows.unionByName(dealt.select("x", "y", "hub", "key", none.cast("binary").alias("elements")))
    rows = rows.repartition("x", "y").sortWithinPartitions("x", "y", F.col("hub").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, own = None, {}
        for batch in batches:
            hubs, keys = [], []
            columns = [batch.column(c).to_pylist() for c in ("x", "y", "hub", "key", "elements")]
            for x, y, hub, key, raw in zip(*columns):
                if (x, y) != cell:
                    cell, own = (x, y), {}
                if hub is None:
                    own[key] = np.frombuffer(raw, np.uint64)
                    continue
                small, large = sorted((own[hub], own[key]), key=len)
                if 100 * len(small) < percent * len(large):
                    continue
                place = np.searchsorted(large, small)
                common = int((large[np.minimum(place, len(large) - 1)] == small).sum())
                if 100 * common >= percent * (len(small) + len(large) - common):
                    hubs.append(hub)
                    keys.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(hubs, pa.int64()), pa.array(keys, pa.int64())], names=["hub", "key"])
        own = {}
        T.give_back()

    return rows.mapInArrow(run, "hub long, key long")


def _close(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _home(size: str, percent: int) -> Column:
    """Band of a size, -1 for small sets."""
    out = F.when(F.col(size) <= SMALL, -1)
    for b, upper in enumerate(band_table(percent)[0].tolist()):
        out = out.when(F.col(size) <= upper, b)
    return out


def _of_band(band: Column, values: np.ndarray, small: int) -> Column:
    """The value of each band, ``small`` for the mark of small sets."""
    return F.when(band == NO_BAND, small).otherwise(F.get(F.array(*[F.lit(int(v)) for v in values]), band))


def _band() -> Column:
    return F.shiftright("sig", 1).bitwiseAND(F.lit(63)).cast("int")


def _apart(both: Column, percent: int) -> Column:
    """Elements in which similar sets may differ whose sizes add up to ``both``."""
    return F.floor(both * (100 - percent) / F.lit(100 + percent))


def _folded(sketch: Column, words: Column) -> Column:
    """The sketch of fewer words."""
    for w in (words * 2, words):
        half = F.zip_with(F.slice(sketch, F.lit(1), w), F.slice(sketch, w + 1, w), lambda x, y: x.bitwiseXOR(y))
        sketch = F.when(F.size(sketch) == 2 * w, half).otherwise(sketch)
    return sketch


def _may_link(apart: Column) -> Column:
    """Whether two sketches (columns s, sketch) differ in ``apart`` bits at most, or one is missing. The first words decide
    for most pairs."""
    first = [F.coalesce(F.bit_count(F.get("s", F.lit(i)).bitwiseXOR(F.get("sketch", F.lit(i)))), F.lit(0)) for i in range(2 * WORDS)]
    bits = F.zip_with("s", "sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    whole = F.aggregate(bits, F.lit(0), lambda x, y: x + y)
    return F.coalesce(F.size("s") != F.size("sketch"), F.lit(True)) | ((sum(first[1:], first[0]) <= apart) & (whole <= apart))


def _formed(members: DataFrame, percent: int) -> DataFrame:
    """A row (a, key, f, filled, apart) for each signature that two nodes of different components share.

    Every such pair has a node outside the largest component (column ``main``) of what it shares, so only those nodes look
    for partners: a group of copies and a stray make as many pairs as the group has members. Signatures count in the band of
    the larger set. Sketches decide before a pair is formed.
    """
    strays = members.filter(F.col("component") != F.col("main")).select(
        "sig", F.col("key").alias("a"), F.col("size").alias("n"), F.col("home").alias("h"), F.col("filled").alias("f"), F.col("component").alias("c"),
        F.col("sketch").alias("s"),
    )
    odd = F.col("sig").bitwiseAND(F.lit(1)) == 1
    apart = _apart(F.col("n") + F.col("size"), percent)
    pairs = strays.join(members, "sig").filter((F.col("c") != F.col("component")) & _close("n", "size", percent))
    once = (F.col("component") == F.col("main")) | (F.col("a") < F.col("key"))
    pairs = pairs.filter(once & (~odd | (F.col("n") != F.col("size"))) & ((_band() == NO_BAND) | (_band() == F.greatest("h", "home"))))
    return pairs.filter(_may_link(apart)).select("a", "key", "f", "filled", apart.alias("apart"))


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (hub, key) of nodes that share enough signatures and lie in different components."""
    need = F.greatest(F.greatest("f", "filled") - F.col("apart"), F.lit(1))
    pairs = _formed(members, percent).groupBy(F.least("a", "key").alias("hub"), F.greatest("a", "key").alias("key"))
    return pairs.agg(F.count("*").alias("shared"), F.max(need).alias("need")).filter("shared >= need").select("hub", "key")


def _largest(members: DataFrame, by: list[str]) -> DataFrame:
    """(by, main, strays): the largest component of what nodes share, and how many nodes lie outside; none where it is the only one."""
    sizes = members.groupBy(*by, "component").agg(F.count("*").alias("n"))
    top = F.max(F.struct("n", "component")).alias("top")
    return sizes.groupBy(*by).agg(F.sum("n").alias("n"), top).select(
        *by, F.col("top.component").alias("main"), (F.col("n") - F.col("top.n")).alias("strays")
    ).filter("strays > 0")


def links_and_components(df: DataFrame, text_col: str = "text", n: int = 5, percent: int = 80, bits: int = 24) -> tuple[DataFrame, DataFrame]:
    """(links, membership): verified links (hub, key) between nodes that join every component, and (key, component) of all
    nodes with a link. Two nodes are in one component exactly if a chain of similar sets leads from one to the other."""
    every = written(shared_signatures(df, text_col, n, percent), "signatures").withColumn("band", _band())
    # a node that shares fewer signatures of a band with all others together than with one similar set has no link there
    most = F.least(F.floor(F.col("size") * 100 / F.lit(percent)), _of_band(F.col("band"), band_table(percent)[0], SMALL))
    need = F.greatest(F.lit(1), F.col("filled") - _apart(F.col("size") + most, percent))
    nodes = every.groupBy("key", "band", "size", "filled").agg(F.count("*").alias("n")).filter(F.col("n") >= need)
    nodes = written(nodes.withColumn("home", _home("size", percent)), "nodes")
    sets = written(node_sets(df, text_col, nodes.select("key").distinct(), n, bits, percent), "sets")
    # which pairs are tried first changes the work, not the result: those that share much, by a quarter of the signatures
    few = every.filter((F.pmod(F.shiftright("sig", 8), F.lit(4)) == 0) | (F.col("size") <= 64)).select("sig", "key", "band")
    few = few.join(nodes, ["key", "band"]).select("sig", "key", "n", "size")
    best = few.groupBy("sig").agg(F.max(F.struct("n", "key", "size")).alias("best")).select("sig", F.col("best.key").alias("hub"), F.col("best.size").alias("m"))
    stars = few.join(best, "sig").filter((F.col("key") != F.col("hub")) & _close("m", "size", percent))
    stars = stars.groupBy("hub", "key", "size").agg(F.count("*").alias("shared")).filter("80 * shared >= size").select("hub", "key")
    first = written(linked(stars, sets, percent), "links")
    found = written(components(first, "hub", "key"), "components")
    named = nodes.join(found.select(F.col("node").alias("key"), "component"), "key", "left")
    named = named.select("key", "band", "size", "filled", "home", F.coalesce("component", "key").alias("component"))
    shared = every.select("sig", "key", "band").join(named, ["key", "band"])
    members = written(shared.join(_largest(shared, ["sig"]), "sig"), "members")
    crowded = members.filter(F.col("strays") > CROWD).join(sets.select("key", "sketch"), "key")
    words = _of_band(F.col("band"), sketch_words(percent), WORDS)
    crowded = written(crowded.withColumn("sketch", _folded(F.col("sketch"), words)), "crowded")
    calm = members.filter(F.col("strays") <= CROWD).withColumn("sketch", F.lit(None).cast("array<long>"))
    rest = _across(calm.unionByName(crowded), percent)
    second = written(linked(rest, sets, percent), "links")
    links = first.unionByName(second)
    top = components(
        second.join(found.select(F.col("node").alias("hub"), F.col("component").alias("a")), "hub", "left")
        .join(found.select(F.col("node").alias("key"), F.col("component").alias("b")), "key", "left")
        .select(F.coalesce("a", "hub").alias("hub"), F.coalesce("b", "key").alias("key")), "hub", "key",
    )
    joined = found.select(F.col("node").alias("key"), "component").unionByName(
        second.select(F.explode(F.array("hub", "key")).alias("key")).distinct()
        .join(found.select(F.col("node").alias("key")), "key", "left_anti").select("key", F.col("key").alias("component"))
    )
    final = joined.join(top.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    return links, final.select("key", F.coalesce("top", "component").alias("component"))


def join_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, bits: int = 24) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Words are runs of characters other than space and 9..13, A-Z lower-cased; a set holds the distinct n-word shingles, or
    the whole word sequence of a shorter text. Rows link where ``percent`` of 100 of the union is shared. component_id is
    the smallest id reachable over links, the row's own included. Null and empty texts have the empty set and link with
    nothing, not with each other either; a row with a null id takes the smallest other id of its component. Repeated rows
    are copies of each other.
    """
    docs = written(document_sets(df, id_col, text_col, n), "documents")
    _, membership = links_and_components(df, text_col, n, percent, bits)
    nodes = docs.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    nodes = nodes.join(membership, "key", "left").filter("n > 1 or component is not null")
    nodes = written(nodes.select("key", "first", F.coalesce("component", "key").alias("component")), "nodes")
    least = nodes.groupBy("component").agg(F.min("first").alias("least"))
    named = nodes.join(least, "component").select("key", "least")
    # rows of the empty set get keys that match nothing and spread over the tasks
    spread = docs.withColumn("_k", F.coalesce(F.col("key").cast("string"), F.concat(F.lit("-"), F.hash("doc_id").cast("string"), F.lit("-"))))
    out = salted_join(spread, named.select(F.col("key").cast("string").alias("_k"), "least"), ["_k"], F.col("doc_id"), salts=8)
    return out.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component, that with the smallest id, with all its columns.

    An id that stands on several rows is one document: it goes if any of its rows has a partner with a smaller id, else
    one of its rows stays. Rows with a null id are all kept.
    """
    found = join_components(df, id_col, text_col, **options).filter("doc_id is not null")
    judged = found.groupBy("doc_id").agg(F.min("component_id").alias("least"), F.count("*").alias("n"))
    marked = written(judged.filter("least < doc_id or n > 1").select(F.col("doc_id").alias("_id"), (F.col("least") < F.col("doc_id")).alias("_gone")), "judged")
    # Spark broadcasts these ids while they are few, else it shuffles both sides
    gone = marked.filter("_gone").select("_id")
    kept = df.join(gone, df[id_col] == gone["_id"], "left_anti")
    twice = marked.filter("not _gone").select("_id")
    if twice.isEmpty():
        return kept
    one = kept.join(twice, kept[id_col] == twice["_id"], "left_semi").dropDuplicates([id_col])
    return kept.join(twice, kept[id_col] == twice["_id"], "left_anti").unionByName(one)
