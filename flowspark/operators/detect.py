"""Scoring flows with rules, isolation forest, supervised model and sequence reconstruction."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.functions import scores as S
from flowspark.functions import vectors as X
from flowspark.functions.keys import directed_key
from flowspark.operators.sequences import tumbling_sequences
from flowspark.operators.autoencoder import AutoencoderParams
from flowspark.operators.training import SequenceParams, reconstruction_udf

EULER = 0.5772156649  # fixed value
ENDS = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")


# --- isolation forest ----------------------------------------------------------------
def path_factor(max_samples: int) -> float:
    return 2 * math.log(max_samples - 1) + EULER - 2 * (max_samples - 1) / max_samples


def _forest(trees: DataFrame, n_estimators: int, max_nodes: int) -> list[dict[str, np.ndarray]]:
    """The trees as node-indexed arrays. Refuses more trees than ``n_estimators`` and more nodes than ``max_nodes``."""
    size = trees.agg(F.count(F.lit(1)).alias("nodes"), F.max("tree").alias("last")).first()
    if size["nodes"] > max_nodes:
        raise ValueError(f"{size['nodes']} tree nodes, more than {max_nodes}; raise max_samples or n_estimators")
    if size["last"] is not None and size["last"] >= n_estimators:
        raise ValueError(f"tree {size['last']} of a forest of {n_estimators}; raise n_estimators")
    rows = trees.toPandas()
    forest = []
    for _, t in rows.groupby("tree"):
        size = int(t["node"].max()) + 1
        known = np.zeros(size, bool)
        idx, lhs, rhs = (np.full(size, -1) for _ in range(3))
        val, leaf = np.zeros(size), np.full(size, np.nan)
        node = t["node"].to_numpy()
        known[node] = True
        idx[node] = t["split_idx"].fillna(-1)
        val[node] = t["split_val"].fillna(0.0)
        lhs[node], rhs[node] = t["lhs"].fillna(-1), t["rhs"].fillna(-1)
        leaf[node] = t["size"].astype("float64")
        forest.append({"known": known, "idx": idx, "val": val, "lhs": lhs, "rhs": rhs, "leaf": leaf})
    return forest


def path_lengths(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Depth plus half the leaf size for every row at once; NaN where a child is missing."""
    at = np.zeros(len(x), int)
    out = np.full(len(x), np.nan)
    live = np.arange(len(x))
    depth = 0
    while len(live):
        here = at[live]
        ok = (here >= 0) & (here < len(tree["known"]))
        ok[ok] = tree["known"][here[ok]]
        live, here = live[ok], here[ok]
        leaf = ~np.isnan(tree["leaf"][here])
        out[live[leaf]] = depth + tree["leaf"][here[leaf]] * 0.5
        live, here = live[~leaf], here[~leaf]
        beyond = tree["idx"][here] >= x.shape[1]
        out[live[beyond]] = depth
        live, here = live[~beyond], here[~beyond]
        if len(live):
            left = x[live, tree["idx"][here]] < tree["val"][here]
            at[live] = np.where(left, tree["lhs"][here], tree["rhs"][here])
        depth += 1
        if depth > len(tree["known"]):  # a cycle: no path ends
            break
    return out


def iforest_score(df: DataFrame, trees: DataFrame | None, max_samples: int = 256, n_estimators: int = 100, vec: str = "vec") -> DataFrame:
    """Add ``anomaly_score`` = 2^(-mean path / c); 0.5 without trees; null where a tree is broken."""
    forest = _forest(trees, n_estimators, n_estimators * 2 * max_samples) if trees is not None else []
    if not forest:
        return df.withColumn("anomaly_score", F.lit(0.5))
    c = path_factor(max_samples)

    @F.pandas_udf(T.DoubleType())
    def score(vectors: pd.Series) -> pd.Series:
        if vectors.empty:
            return pd.Series([], dtype="float64")
        x = np.vstack(vectors.to_numpy())
        total = np.zeros(len(x))
        for tree in forest:
            total += path_lengths(tree, x)
        value = np.full(len(x), 0.5) if c == 0 else 2.0 ** (-(total / len(forest)) / c)
        return pd.Series(value).astype("Float64").mask(np.isnan(value))

    return df.withColumn("anomaly_score", score(F.col(vec)))


# --- rules -----------------------------------------------------------------------------
def first_rule(flows: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``rule_id, rule_name, rule_severity`` of the first active rule a flow matches.

    Every rule with a selection block tests the same two indicators, so the first such rule
    in load order decides; only its one row is fetched.
    """
    active = rules.filter("has_selection").orderBy("path").limit(1).collect()
    hit = F.lit(False)
    names: tuple = (None, None, None)
    if active:
        flows = S.rule_predicates(flows)
        hit = F.col("syn_flood") | F.col("port_scan")
        names = (active[0]["id"], active[0]["title"], active[0]["level"])
    matched = flows.withColumn("rule_hit", F.coalesce(hit, F.lit(False)))
    for column, value in zip(("rule_id", "rule_name", "rule_severity"), names, strict=True):
        matched = matched.withColumn(column, F.when(F.col("rule_hit"), F.lit(value)).cast("string"))
    return matched.drop("syn_flood", "port_scan")


def fast_detect(
    flows: DataFrame,
    trees: DataFrame | None = None,
    norm: tuple[Sequence[float], Sequence[float]] | None = None,
    rules: DataFrame | None = None,
    threshold: float = -0.5,
    mode: str = "low",
    max_samples: int = 256,
    version: str = "iforest",
) -> DataFrame:
    """One detection per flow: forest score, first matching rule, anomaly flag and confidence.

    ``mode="low"`` calls scores below the threshold anomalous, ``"high"`` those above it.
    """
    df = X.lenient_vector(flows)
    vec = F.col("vec")
    if norm is not None:
        vec = X.zscore("vec", X.literal_vector(norm[0]), X.literal_vector(norm[1]))
    df = iforest_score(df.withColumn("vec", vec), trees, max_samples)
    if rules is None:
        df = df.withColumns({"rule_hit": F.lit(False), **{c: F.lit(None).cast("string") for c in ("rule_id", "rule_name", "rule_severity")}})
    else:
        df = first_rule(df, rules)
    beyond = F.col("anomaly_score") < threshold if mode == "low" else F.col("anomaly_score") > threshold
    return df.withColumns(
        {
            "is_anomaly": F.coalesce(beyond, F.lit(False)) | F.col("rule_hit"),
            "confidence": S.confidence("anomaly_score", threshold),
            "model_version": F.lit(version),
            "inference_time_ms": F.lit(None).cast("double"),
            "_error": F.when(F.col("anomaly_score").isNull(), F.lit("broken tree")),
        }
    ).drop("rule_hit")


# --- supervised and sequence ------------------------------------------------------------
def supervised_detect(flows: DataFrame, model, threshold: float = 0.5, version: str = "gbt", flat_ok: bool = False) -> DataFrame:
    """Complete vectors with ``anomaly_probability`` and ``is_anomaly`` (probability above threshold)."""
    rows = X.strict_vector(flows, flat_ok=flat_ok).withColumn("_x", array_to_vector("vec"))
    scored = model.setFeaturesCol("_x").setPredictionCol("_pred").setRawPredictionCol("_raw").setProbabilityCol("_prob")
    p = F.get(vector_to_array("_prob"), F.lit(1))
    return (
        scored.transform(rows)
        .withColumns({"anomaly_probability": p, "is_anomaly": p > threshold, "model_version": F.lit(version), "inference_time_ms": F.lit(None).cast("double")})
        .drop("_x", "_pred", "_raw", "_prob")
    )


def score_windows(windows: DataFrame, params: SequenceParams | AutoencoderParams) -> DataFrame:
    """Add ``reconstruction_error, anomaly_score, is_anomaly`` to windows of vectors."""
    flat = F.flatten(X.zscore_sequence("seq", X.literal_vector(params.means), X.literal_vector(params.scales)))
    error = params.error(flat) if isinstance(params, AutoencoderParams) else reconstruction_udf(params.components)(flat)
    err = windows.withColumn("reconstruction_error", error)
    return err.withColumns(
        {
            "anomaly_score": S.normalize_score("reconstruction_error", params.threshold),
            "is_anomaly": F.col("reconstruction_error") > params.threshold,
            "model_version": F.lit(params.version),
            "inference_time_ms": F.lit(None).cast("double"),
        }
    )


def sequence_detect(flows: DataFrame, params: SequenceParams | AutoencoderParams | None, tie: str = "id") -> DataFrame:
    """Count windows of complete vectors scored by reconstruction error. No parameters, no output."""
    return vectors_detect(X.strict_vector(flows), params, tie)


def vectors_detect(rows: DataFrame, params: SequenceParams | AutoencoderParams | None, tie: str = "id") -> DataFrame:
    """``sequence_detect`` of rows that hold their vector (``vec``)."""
    windows = tumbling_sequences(rows, params.length if params else 10, tie)
    if params is None:
        return windows.filter(F.lit(False))
    return score_windows(windows, params).drop("seq")


def join_scores(flows: DataFrame, scores: DataFrame) -> DataFrame:
    """Flow rows with the reconstruction error of the window they close (left join)."""
    errors = scores.select("flow_key", "timestamp", "reconstruction_error")
    return flows.join(errors, ["flow_key", "timestamp"], "left")


# --- detections ---------------------------------------------------------------------------
TYPES = {"fast": "fast_path", "sequence": "deep_path_lstm_ae", "supervised": "xgboost_supervised"}  # fixed values


def detection_rows(df: DataFrame, kind: str) -> DataFrame:
    """A detector's output in the common detection columns; what it lacks is null."""
    from flowspark.schemas import DETECTION

    fields = [f.split()[:2] for f in DETECTION.split(",")]
    given: dict[str, Column] = {"alert_type": F.lit(TYPES[kind])}
    if "flow_key" not in df.columns and all(c in df.columns for c in ENDS):
        given["flow_key"] = directed_key()
    out = []
    for name, kind_ in fields:
        value = given.get(name, F.col(name) if name in df.columns else F.lit(None))
        out.append(value.cast(kind_).alias(name))
    return df.select(*out)
