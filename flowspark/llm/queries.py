"""The registered queries of this folder and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm import (
    backoff_lm, decontaminate, jaccard_join, language, lexical_search, licenses, norm_search, quality_model, quality_rules, secrets, sentence_pieces, warc, whitening,
)
from flowspark.llm.shared import shared_path
from flowspark.llm.tokens import remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def sql_words(text: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '[^\\x20\\x09-\\x0D]+')"


def sql_shingles(source: str, key: str) -> str:
    """Rows (key, s) of the distinct five-word shingles."""
    return f"""
    SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
    FROM (SELECT {key}, {sql_words(sql_lower("text"))} AS w FROM {source})"""


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_SQL_B32 = " || ".join(
    f"substr('{_B32}', 1 + ((CAST('0x' || substr(h, {5 * i + 1}, 5) AS INTEGER) >> {s}) & 31), 1)" for i in range(8) for s in (15, 10, 5, 0)
)


@query(
    "op1_warc",
    f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_SQL_B32} AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM m""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).select(
        F.col("record").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


@query("op2_backoff_lm")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder("doc_id", 7) == 2
    scored = backoff_lm.score_texts(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op3_secret_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs)).select(
        "doc_id", "finding_no", F.sha2("value", 256).alias("value_digest"), F.length("value").alias("n_chars"), "score", "is_secret"
    )


@query("op4_license_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: the source is the top folder, and documents that are mostly a notice are licence files."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000), F.floor(F.col("doc_id") / 50), "doc_id")
    mostly = 3 * F.length(licenses.notice(F.col("text"))) >= F.length("text")
    return licenses.scan(docs, path=path, licence_file=mostly, share=1 / 3)


@query("op5_sentence_pieces")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.round_trip(table(spark, sf_dir, "documents"), sentence_pieces.load())


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    model = language.fit(docs.filter(~held_out))
    return language.predict(docs, model, extra={"held_out": held_out}).select("doc_id", "held_out", "lang_pred", "score")


@query("op7_quality_classifier")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), remainder("doc_id", 5) == 0
    model = quality_model.fit(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return quality_model.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query(
    "op8_jaccard_join",
    f"""
WITH RECURSIVE s AS MATERIALIZED ({sql_shingles("documents", "doc_id")}),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS MATERIALIZED (
    SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id
FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(table(spark, sf_dir, "documents"))


@query(
    "op9_benchmark_decontamination",
    f"""
WITH d AS ({sql_shingles("documents", "doc_id")}), b AS ({sql_shingles("benchmark", "item_id")}),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY 1)
SELECT d.doc_id, b.item_id, any_value(n_item) AS n_item, count(*) AS n_shared
FROM b JOIN d USING (s) JOIN n USING (item_id)
GROUP BY d.doc_id, b.item_id HAVING 100 * count(*) >= 80 * any_value(n_item)""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_RULES = " + ".join(f"CASE WHEN {test} THEN {1 << i} ELSE 0 END" for i, (_, test) in enumerate(quality_rules.RULES))


@query(
    "op10_quality_rules",
    f"""
WITH w AS (
    SELECT doc_id, coalesce(text, '') AS t, {sql_words("text")} AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
    FROM documents),
g AS (SELECT *, CASE WHEN len(w) < 3 THEN [] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END AS g FROM w),
u AS (SELECT doc_id, unnest(g) AS x, unnest(range(1, len(g) + 1)) AS i FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM u) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY 1),
m AS (
    SELECT g.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(len(l) AS BIGINT) AS n_lines,
        CAST(len(list_filter(w, lambda x: strlen(x) > 2 AND regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS BIGINT) AS n_upper_words,
        CAST(len(list_filter(w, lambda x: NOT regexp_matches(x, '[A-Za-z\\x{{80}}-\\x{{10FFFF}}]'))) AS BIGINT) AS n_bare_words
    FROM g LEFT JOIN c ON g.doc_id = c.doc_id),
f AS (SELECT *, CAST({_SQL_RULES} AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed,
    failed & {quality_rules.POLICIES["base"]} <> 0 AS base_failed, failed & {quality_rules.POLICIES["v2"]} = 0 AS kept
FROM f""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.ledger(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed",
        (~quality_rules.passes("base")).alias("base_failed"), quality_rules.passes("v2").alias("kept"),
    )


_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


@query(
    "op11_lexical_search",
    f"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({sql_lower("coalesce(text, '')")}, '{_TERM}') AS w FROM documents),
c AS (SELECT count(*) AS n, sum(len(w)) AS l FROM d WHERE len(w) > 0),
p AS MATERIALIZED (SELECT doc_id, len(w) AS n, t, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS t FROM d) GROUP BY ALL),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({sql_lower("coalesce(text, '')")}, '{_TERM}')) AS t FROM benchmark),
f AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(c.n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY t),
s AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * p.n * c.n) // CAST(c.l AS BIGINT))))) AS BIGINT) AS score
    FROM b JOIN f USING (t) JOIN p USING (t), c GROUP BY item_id, doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query(
    "op13_norm_search",
    """
WITH v AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
