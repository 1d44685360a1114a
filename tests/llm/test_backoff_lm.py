import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from flowspark.llm import backoff_lm as B
from flowspark.llm.tokens import remainder


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def brute(rows):
    """Scores from dictionaries over the whole corpus; rows are (id, text, learned)."""
    uni, bi, follow = Counter(), Counter(), defaultdict(set)
    for _, text, learned in rows:
        if learned:
            t = [None, *words(text), b"</s>"]
            uni.update(t)
            for h, w in zip(t, t[1:]):
                bi[h, w] += 1
                follow[h].add(w)
    starts = uni.pop(None, 0)
    n, v = sum(uni.values()), len(uni)

    def discount(c):
        once, twice = (sum(1 for x in c.values() if x == k) for k in (1, 2))
        return min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.5

    d1, d2 = discount(uni), discount(bi)
    root = lambda w: (uni[w] - d1) / n if uni[w] else (d1 * v / n if n else 1.0)
    out = []
    for i, text, _ in rows:
        t = [*words(text), b"</s>"]
        score, state = 0.0, None
        for w in t:
            c = starts if state is None else uni[state]
            p = max(bi[state, w] - d2, 0) / c + d2 * len(follow[state]) / c * root(w) if c else root(w)
            score += math.log10(p)
            state = w
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t)
        out.append((i, len(t), sum(1 for w in t if uni[w]), n, base, score))
    return out


@pytest.mark.parametrize("share", ["some", "none"])
def test_scores_equal_dictionaries(spark, sf_dir, share):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).select("doc_id", "text")
    extra = [(900, None), (901, ""), (902, "a a a b"), (902, "a a a b"), (903, "A  a\n\x0bB é"), (None, "a b")]
    docs = spark.createDataFrame([tuple(r) for r in docs.collect()] + extra, "doc_id long, text string")
    learn = remainder("doc_id", 7) != 2 if share == "some" else F.lit(False)
    got = B.score_texts(docs.withColumn("block", F.lit("clash")), learn).collect()
    rows = [(r.doc_id, r.text, share == "some" and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in docs.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[4])
    want = sorted(brute(rows), key=key)
    have = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    assert len(want) == len(have)
    for w, h in zip(want, have):
        assert w[:4] == h[:4]
        assert h[4:] == pytest.approx(w[4:], rel=1e-9, abs=1e-9)


def test_probabilities_of_a_state_sum_to_one(spark):
    texts = ["a b a c", "a b", "c a", "b"]
    vocabulary = ["a", "b", "c"]
    # p(first word) over known words, the end and one unknown word: one-word texts end with p(end | word)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    probes = spark.createDataFrame([(100 + i, w) for i, w in enumerate([*vocabulary, "zzz", ""])], "doc_id int, text string")
    ends = spark.createDataFrame([(200 + i, f"{w} {x}".strip()) for i, (w, x) in enumerate((w, x) for w in vocabulary for x in vocabulary)], "doc_id int, text string")
    got = {r.doc_id: 10**r.score for r in B.score_texts(df.union(probes).union(ends), F.col("doc_id") < 100).collect()}
    # P(text starts with a word) = P(word, end) / P(end | word), and P(end | word) = 1 - sum of next words - unknown
    want = brute([(i, t, True) for i, t in enumerate(texts)] + [(100 + i, w, False) for i, w in enumerate([*vocabulary, "zzz", ""])])
    for i, *_, score in want[len(texts):]:
        assert got[i] == pytest.approx(10**score)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert B.score_texts(df, F.lit(True)).count() == 0
