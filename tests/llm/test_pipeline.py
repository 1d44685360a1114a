"""The pipeline's stages against plain versions of their decisions, on a small folder of tables."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from flowspark.llm.shared import shared_path
from tests_llm_words import edit, prose, shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(8)
    items = [(k, prose(25, rng)) for k in range(6)]
    key = hashlib.sha1(b"secret").hexdigest()
    texts = [prose(rng.randint(30, 200), rng) for _ in range(40)]
    texts += [edit(texts[0], 0.01, rng), texts[1], texts[2] + " end", None, "", "123 456", "--", f"{prose(40, rng)} {items[0][1]} {prose(20, rng)}", items[3][1]]
    texts += [f'{prose(30, rng)} token = "{key}" {prose(10, rng)}', prose(9_000, rng)]
    rows = [(i, t, "en", None if i % 9 == 0 else f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(60 + i, " ".join("öüß" + w for w in prose(40, rng).split()), "de", "src1", 10) for i in range(8)]
    folder = shared_path(spark, "tables")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items, key


def test_stages(spark, tables):
    folder, rows, items, key = tables
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in P.STAGES:
        out = shared_path(spark, name)
        stage(spark, docs, folder).write.parquet(out)
        docs = spark.read.parquet(out)
        seen[name] = docs.collect()
        if name != P.STAGES[-1][0]:
            assert docs.columns == P.COLUMNS
    text = {i: t for i, t, *_ in rows}
    letters = {i for i, t in text.items() if t and re.search(r"[^\W\d_]", t)}
    assert {r.doc_id for r in seen["language_id"]} == letters
    alone = set()
    for i in sorted(letters):
        s = shingles(text[i])
        if not any(100 * len(s & shingles(text[j])) >= 80 * len(s | shingles(text[j])) for j in alone):
            alone.add(i)
    assert {r.doc_id for r in seen["jaccard_join"]} == alone
    clean = {i for i in alone if not any(100 * len(shingles(x) & shingles(text[i])) >= 80 * len(shingles(x)) for _, x in items)}
    assert {r.doc_id for r in seen["decontamination"]} == clean and clean < alone
    assert {r.doc_id: (r.text, r.n_chars) for r in seen["secret_scan"]} == {
        i: (text[i].replace(key, "<SECRET>"), len(text[i].replace(key, "<SECRET>"))) for i in clean
    }
    last = {r.doc_id: r for r in seen["sentence_pieces"]}
    assert set(last) == clean and all(r.round_trip for r in last.values())
    assert all(last[i].text_digest == hashlib.sha1(text[i].replace(key, "<SECRET>").encode()).hexdigest() for i in clean)


def test_run_and_empty_documents(spark, tables):
    folder, rows, *_ = tables
    empty = shared_path(spark, "tables")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{empty}/benchmark.parquet")
    assert P.run(spark, empty).count() == 0
    got = P.run(spark, folder)
    assert got.count() == got.select("doc_id").distinct().count() and got.filter(~F.col("round_trip")).count() == 0
