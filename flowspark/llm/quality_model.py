"""Quality classifier as a sparse rule ensemble.

A forest over text statistics is taken apart into its tree paths; each path is a conjunctive rule. A lasso logistic
regression over the rules' truth values keeps few of them, and those are compiled into one Spark column expression.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm import trees
from flowspark.llm.quality_rules import measure
from flowspark.session import durable

_WORDS = "greatest(n_words, 1)"
#: Statistic -> SQL over the measurements of a text.
STATISTICS: dict[str, str] = {
    "log_words": f"log2({_WORDS})",
    "word_length": f"word_chars / {_WORDS}",
    "symbol_share": f"n_symbols / {_WORDS}",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": f"n_repeat_words / {_WORDS}",
    "same_words": f"n_same_words / {_WORDS}",
    "upper_words": f"n_upper_words / {_WORDS}",
    "bare_words": f"n_bare_words / {_WORDS}",
    "line_words": "n_words / greatest(n_lines, 1)",
}


@dataclass(frozen=True)
class RuleEnsemble:
    """log-odds = bias + sum of weights of the rules that hold."""

    bias: float
    weighted: tuple[tuple[trees.Rule, float], ...]

    def score(self) -> Column:
        """Probability of label 1 over the statistic columns."""
        odds = F.lit(self.bias)
        for rule, weight in self.weighted:
            odds = odds + F.when(trees.holds(rule, _statistic), F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))

    def describe(self) -> list[str]:
        names = list(STATISTICS)
        return [
            f"{weight:+.3f} if " + " and ".join(f"{names[f]} {'<=' if u else '>'} {c:g}" for f, u, c in rule)
            for rule, weight in self.weighted
        ]


def _statistic(i: int) -> Column:
    return F.col(list(STATISTICS)[i])


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, statistics); null and empty texts have 0 words and so 0 everywhere."""
    return measure(df, id_col, text_col).select("doc_id", *[F.expr(sql).cast("double").alias(c) for c, sql in STATISTICS.items()])


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_rows: int = 20_000, n_trees: int = 20, depth: int = 4, penalty: float = 0.0005, seed: int = 7,
) -> RuleEnsemble:
    """Fit on at most ``max_rows`` labelled documents, those with the smallest hashes of their id.

    Labels other than 0 and 1 and null ids are left out; a document labelled twice counts once, with the larger label.
    With no rows the score is 0.5 everywhere, with one class it is that class.
    """
    chosen = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"))
        .filter("_id is not null and label in (0, 1)")
        .groupBy("_id")
        .agg(F.max("label").cast("double").alias("label"))
        .orderBy(F.xxhash64(F.lit(seed), "_id"), "_id")
        .limit(max_rows)
    )
    texts = docs.join(F.broadcast(chosen), docs[id_col] == chosen["_id"])  # max_rows rows
    stats = statistics(texts.select(F.struct("_id", "label").alias("_row"), F.col(text_col)), "_row", text_col)
    rows = durable(stats.select("doc_id.label", F.array(*STATISTICS).alias("x")).repartition(2))
    seen = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    if len(seen) < 2:
        return RuleEnsemble({None: 0.0, 0.0: -8.0, 1.0: 8.0}[next(iter(seen), None)], ())
    forest = RandomForestClassifier(numTrees=n_trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", maxBins=64).fit(
        rows.select("label", array_to_vector("x").alias("features"))
    )
    share = seen[1.0] / (seen[0.0] + seen[1.0])
    found = sorted({r for t in forest.trees for r in trees.rules(trees.read_tree(t.toDebugString))})
    if not found:  # statistics that don't differ
        return RuleEnsemble(math.log(share / (1 - share)), ())

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist()).reshape(-1, len(STATISTICS))
            out = np.ones((len(x), len(found)))
            for i, rule in enumerate(found):
                for f, upper, cut in rule:
                    out[:, i] *= x[:, f] <= cut if upper else x[:, f] > cut
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(list(out), pa.list_(pa.float64()))], names=["label", "truth"])

    truths = rows.mapInArrow(test, "label double, truth array<double>")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=30, standardization=False).fit(
        truths.select("label", array_to_vector("truth").alias("features"))
    )
    weights = lasso.coefficients.toArray()
    return RuleEnsemble(float(lasso.intercept), tuple((r, float(w)) for r, w in zip(found, weights) if w))


def score(df: DataFrame, model: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every row; null and empty texts are scored like texts without words."""
    scored = statistics(df, id_col, text_col).select("doc_id", model.score().alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
