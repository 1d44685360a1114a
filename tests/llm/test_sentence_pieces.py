import os
import random

import numpy as np
import pytest

from flowspark.llm import sentence_pieces as S

PIECES = S.Pieces(
    surfaces=("▁", "a", "b", "ab", "ba", "aab", "▁a", "▁ab", "▁▁", "abab", "bbb", "c"),
    scores=(-3.0, -2.0, -2.0, -3.0, -3.0, -4.0, -3.0, -4.0, -5.0, -5.0, -6.0, -9.0),
    ids=tuple(range(12)),
    bytes_=(),
    unknown=12,
    surface_of=(b" ", b"a", b"b", b"ab", b"ba", b"aab", b" a", b" ab", b"  ", b"abab", b"bbb", b"c", " ⁇ ".encode()),
)


def brute(text: str, pieces: S.Pieces) -> list[int]:
    """Plain left-to-right dynamic programme over the whole text; at equal scores the longest last piece."""
    s = S.marked(text)
    table = dict(zip(pieces.surfaces, zip(pieces.scores, pieces.ids)))
    longest, unk = max(map(len, pieces.surfaces)), min(pieces.scores) - 10
    best = [(0.0, None, ())] + [None] * len(s)
    for b in range(1, len(s) + 1):
        for a in range(max(0, b - longest), b):
            sub = s[a:b]
            if sub in table:
                step = (table[sub][0], (table[sub][1],))
            elif b == a + 1:
                step = (unk, tuple(pieces.bytes_[x] for x in sub.encode()) if pieces.bytes_ else (pieces.unknown,))
            else:
                continue
            if best[b] is None or best[a][0] + step[0] > best[b][0]:
                best[b] = (best[a][0] + step[0], a, step[1])
    out, at = [], len(s)
    while at:
        out.append(best[at][2])
        at = best[at][1]
    return [i for ids in reversed(out) for i in ids]


def test_max_plus_is_associative():
    rng = np.random.default_rng(1)
    a, b, c = (rng.integers(-9, 0, (5, 5)).astype(float) for _ in range(3))
    assert (S.max_plus(S.max_plus(a, b), c) == S.max_plus(a, S.max_plus(b, c))).all()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    made = ["".join(rng.choice("aaabbb c\nx é") for _ in range(rng.choice((1, 7, 30, 90, 400)))) for _ in range(60)]
    return [None, "", " ", "  ", "a" * 300, "ab" * 700, "x" * 50, *made, *made[:5]]


def test_scan_equals_whole_text_programme(spark, texts):
    df = spark.createDataFrame([(i // 2, t, "clash") for i, t in enumerate(texts)], "doc_id int, text string, ids string")
    got = S.encode(df, PIECES, size=8).collect()
    assert len(got) == len(texts)
    want = sorted((i // 2, brute(t or "", PIECES)) for i, t in enumerate(texts))
    assert sorted((r.doc_id, list(r.ids)) for r in got) == want


def test_blocks_of_chunks(spark, texts, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 3)
    df = spark.createDataFrame([(7, "ab ba" * 60 + "bbb" * 40)], "doc_id int, text string")
    assert list(S.encode(df, PIECES, size=7).first().ids) == brute("ab ba" * 60 + "bbb" * 40, PIECES)


@pytest.mark.skipif(not os.path.exists(S.MODEL), reason="no public tokenizer files")
def test_public_model_round_trip(spark):
    pieces = S.load()
    texts = ["Hello  world", " lead\n\nnew\tline ", "日本語 ÿ 😀", "a" * 5000, "word " * 3000, "éè" * 900, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    encoded = S.encode(df, pieces, size=100)
    ids = {r.doc_id: list(r.ids) for r in encoded.collect()}
    for i in (0, 1, 2, 5):
        assert ids[i] == brute(texts[i], pieces)
    assert {r.doc_id: r.text for r in S.decode(encoded, pieces).collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id int, text string")
    assert S.decode(S.encode(df, PIECES), PIECES).count() == 0
