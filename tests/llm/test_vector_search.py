"""Ranked lexical search, whitening and norm-bucketed top-k against brute force."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.llm import lexical_search, norm_search, whitening

VECTORS = "vec_id long, embedding array<float>, x string, bound int, part int"


def vector_rows(seed=3, n=400, d=12):
    rnd = np.random.default_rng(seed)
    rows = [(i, [float(v) for v in rnd.normal(size=d) * (1 + i % 7) / 8]) for i in range(n)]
    base = rnd.normal(size=d)
    rows += [(1000 + i, [float(v) for v in base + rnd.normal(size=d) * 0.01]) for i in range(100)]  # near copies
    rows += [(2000 + i, [0.5] * d) for i in range(60)]  # exact copies: ties
    rows += [(3000, None), (3020, [1.0] * (d - 1) + [None]), (3040, [float("nan")] * d), (3060, [float("inf")] * d)]
    rows += [(3080, [0.0] * d), (3100, []), (3120, [1.0]), (None, [1.0] * d), (3140, [9e4] * d), (2000, [0.5] * d)]
    return [(i, v, "clash", 1, 2) for i, v in rows]


def integers(v, scale=64):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(scale * float(np.float32(x))) for x in v]


def brute_top(rows, k):
    good = [(i, x) for i, v, *_ in rows if i is not None and (x := integers(v)) is not None]
    out = []
    for q, x in sorted({i: x for i, x in reversed(good) if i % 20 == 0}.items()):
        scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in good if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("k", [1, 20, 1000])
def test_top_k(spark, monkeypatch, k):
    monkeypatch.setattr(norm_search, "QUERIES", 10)
    rows = vector_rows()
    got = norm_search.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0, k=k)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == brute_top(rows, k)


def test_top_k_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert norm_search.top_k(empty, F.col("vec_id") % 20 == 0).count() == 0
    nulls = spark.createDataFrame([(20, None, "", 0, 0), (None, [1.0], "", 0, 0)], VECTORS)
    assert norm_search.top_k(nulls, F.col("vec_id") % 20 == 0).count() == 0
    alone = spark.createDataFrame([(20, [1.0], "", 0, 0)], VECTORS)
    assert norm_search.top_k(alone, F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("cosine", [-2.0, 0.5, 2.0])
def test_both_prunings_are_exact(monkeypatch, cosine):
    """Coordinates or lengths alone give what a plain product gives."""
    monkeypatch.setattr(norm_search, "COSINE", cosine)
    rnd = np.random.default_rng(1)
    x = np.floor(64 * rnd.normal(size=(500, 8)) * rnd.random((500, 1))).astype(np.int64)
    x[100:200] = x[0] + rnd.integers(-1, 2, (100, 8))
    norms = np.sqrt((x.astype(float) ** 2).sum(axis=1))
    order = np.argsort(-norms, kind="stable")
    ids = np.arange(500)
    s = norm_search.Searcher(ids[:40], norms[:40], x[:40], np.full(40, -np.inf), 5)
    from flowspark.llm import vectors as V

    for at in range(0, 500, 50):
        some = order[at : at + 50]
        s.look(norm_search.Bucket(ids[some].astype(np.int64).tobytes(), norms[some].tobytes(), V.packed(x[some]), 8))
    for q in range(40):
        want = sorted((-int(x[q] @ x[i]), i) for i in range(500) if i != q)[:5]
        assert list(zip(s.scores[q].tolist(), s.found[q].tolist())) == [(-a, b) for a, b in want]


# --- whitening ------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "x",
    [
        np.random.default_rng(0).normal(size=(300, 20)),
        np.random.default_rng(1).normal(size=(300, 8)) * 10.0 ** np.arange(8),
        np.random.default_rng(2).normal(size=(300, 3)) @ np.random.default_rng(3).normal(size=(3, 9)),
        np.random.default_rng(4).normal(size=(6, 12)),
        np.vstack((np.eye(7), -np.eye(7))),
        np.random.default_rng(5).integers(0, 2, (90, 30)).astype(float),
        np.random.default_rng(6).normal(size=(9, 1)),
        np.random.default_rng(7).normal(size=(9, 2)),
    ],
    ids=["plain", "graded", "low rank", "few rows", "equal values", "bits", "one", "two"],
)
def test_solver(x):
    y = x - x.mean(axis=0)
    r = np.linalg.qr(y, mode="r")
    r = np.vstack((r, np.zeros((y.shape[1] - len(r), y.shape[1]))))
    values, vectors = whitening.right_vectors(r, y.shape[1])
    want = np.linalg.svd(y, compute_uv=False) ** 2
    top = want > 1e-20 * want[0]
    assert np.allclose(values[: len(want)][top], want[top], rtol=1e-8)
    v = vectors[:, : int(top.sum())]
    assert np.abs(v.T @ v - np.eye(v.shape[1])).max() < 1e-9
    assert np.abs(y.T @ (y @ v) - v * values[: v.shape[1]]).max() < 1e-12 * max(values[0], 1)


def test_whiten(spark):
    rows = [r for r in vector_rows(d=6) if r[0] != 3140]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = whitening.whiten(df, components=4)
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    got = got.collect()
    good = [(i, x + [0] * (6 - len(x))) for i, v, *_ in rows if (x := integers(v)) is not None]
    x = np.array([v for _, v in good], dtype=object) + 1_000_000
    n, sums = len(good), x.sum(axis=0)
    assert len(got) == 4 * n and {r["n"] for r in got} == {n}
    deviation = Counter((i, int(sum((n * a - s) ** 2 for a, s in zip(v, sums)))) for (i, _), v in zip(good, x))
    assert Counter((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == deviation
    y = (x * n - sums).astype(float) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    for c in range(4):
        mine = sorted((r["deviation"], abs(r["whitened"])) for r in got if r["component"] == c + 1)
        plain = sorted((int(sum((n * a - s) ** 2 for a, s in zip(r, sums))), abs(w)) for r, w in zip(x, (y @ v[:, c]) / math.sqrt(e[c])))
        assert np.allclose([b for _, b in mine], [b for _, b in plain], atol=1e-8)
        assert np.isclose(next(r["explained"] for r in got if r["component"] == c + 1), e[c] / e.sum(), rtol=1e-10)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0]), (None, [1.0])], [(1, []), (2, [])]])
def test_whiten_without_variance(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0


# --- lexical search -------------------------------------------------------------------------
def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute_search(docs, items, k=10):
    held = [(i, Counter(words(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(words(t))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in held:
            m = 10 + (90 * sum(c.values()) * n) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0 and i is not None:
                scores.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_search(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    monkeypatch.setattr(lexical_search, "ITEMS", 6)
    vocabulary = [f"w{int(i)}" if i % 3 else f"É{int(i)}ß" for i in range(300)]
    draw = lambda n: " ".join(vocabulary[min(299, int(rnd.exponential(30)))] for _ in range(n))
    docs = [(i, draw(int(rnd.integers(1, 120)))) for i in range(500)]
    docs += [(600 + i, "W5, w7; same-text W5") for i in range(30)]  # ties
    docs += [(700, None), (701, ""), (702, "..."), (None, "w5 w299 rare"), (703, draw(30_000)), (5, "w5 again"), (704, "RARE É É é")]
    items = [(i, draw(12)) for i in range(20)] + [(30, None), (31, ""), (32, "nowhere"), (33, "w5 w7 same text"), (34, "rare é"), (None, "w5"), (33, "again"), (35, draw(3000))]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, term int, cell string").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = lexical_search.search(d, b)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == brute_search(docs, items)


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0


def test_few_accumulators():
    """A rare term opens accumulators, a common one behind it none; scores stay exact."""
    from flowspark.llm import tokens as T
    import pyarrow as pa

    texts = ["rare common"] * 12 + ["common"] * 500
    f = T.flat(pa.array(texts))
    of, term = lexical_search.terms(f)
    common, rare = term[-1], next(t for t in term if t != term[-1])
    both = sorted([(common, 512, np.arange(512)), (rare, 12, np.arange(12))])
    row = {
        "ids": np.arange(512).tobytes(), "given": np.ones(512, bool).tobytes(), "lengths": np.bincount(of).astype(np.int64).tobytes(),
        "terms": np.array([b[0] for b in both], np.uint64).tobytes(), "counts": np.array([b[1] for b in both], np.uint32).tobytes(),
        "places": np.concatenate([b[2] for b in both]).astype(np.uint32).tobytes(), "freqs": np.ones(524, np.uint32).tobytes(),
    }
    index = lexical_search.Index(row, 512, int(len(of)))
    place, score = lexical_search.search_block(index, np.array([rare, common], np.uint64), np.array([3000, 1]), 10, 0)
    assert place.tolist() == list(range(12))
    assert score.tolist() == [3000 * int(index.shares[-1]) + int(index.shares[0] if common < rare else index.shares[-1])] * 12
