"""Registered vector, sequence, training and detector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.functions import scores as S
from flowspark.functions import vectors as X
from flowspark.operators import autoencoder as E
from flowspark.operators import detect as D
from flowspark.operators import flows as O
from flowspark.operators import sequences as Q
from flowspark.operators import training as T
from flowspark.operators.ordinal import split_ordered
from flowspark.plans import views as V
from flowspark.plans.catalog import q4, query, sql_q4, table
from flowspark.schemas import FEATURES
from flowspark.session import stored
from flowspark.sources.tables import union_detections

# --- vectors ---------------------------------------------------------------------------
# A flow record per event whose feature map is complete, lacks one entry, or holds text.
_VEC_SQL = """
vf AS (
  SELECT event_id, 'u' || (user_id % 40) AS flow_key, epoch_us(ts) / CAST(1e6 AS DOUBLE) AS "timestamp", value, event_type,
    event_id % 9 = 0 AS lacking, event_id % 10 = 0 AS garbled FROM events
)"""


def vector_flows(spark, d):
    """Nested feature maps: element i is value + i."""
    e = table(spark, d, "events")
    names = F.array(*[F.lit(n) for n in FEATURES])
    numbers = F.transform(F.sequence(F.lit(0), F.lit(50)), lambda i: (F.col("value") + i).cast("string"))
    whole = F.map_from_arrays(names, numbers)
    lacking = F.map_filter(whole, lambda k, v: k != "fwd_bytes")
    garbled = F.transform_values(whole, lambda k, v: F.when(k == "idle_min", "n/a").otherwise(v))
    features = F.when(F.col("event_id") % 9 == 0, lacking).when(F.col("event_id") % 10 == 0, garbled).otherwise(whole)
    return e.select(
        "event_id", F.concat(F.lit("u"), F.col("user_id") % 40).alias("flow_key"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("timestamp"), features.alias("features"),
        F.when(F.col("event_type") == "error", "1").when(F.col("event_type") == "signup", "2").otherwise("0").alias("label"),
        "value",
    )


@query(
    "strict_vector",
    f"WITH {_VEC_SQL} SELECT event_id, value AS first, value + 50 AS last, 51 AS size FROM vf WHERE NOT lacking AND NOT garbled",
)
def strict_vector(spark, d):
    df = X.strict_vector(vector_flows(spark, d))
    return df.select("event_id", F.get("vec", F.lit(0)).alias("first"), F.get("vec", F.lit(50)).alias("last"), F.size("vec").alias("size"))


@query(
    "lenient_vector",
    f"""WITH {_VEC_SQL} SELECT event_id, CASE WHEN lacking THEN 0 ELSE value + 3 END AS fwd_bytes,
  CASE WHEN garbled AND NOT lacking THEN 0 ELSE value + 50 END AS idle_min FROM vf""",
)
def lenient_vector(spark, d):
    df = X.lenient_vector(vector_flows(spark, d))
    picked = X.select_features("vec", ["idle_min", "no_such_feature", "fwd_bytes"])
    return df.select("event_id", F.get(picked, F.lit(1)).alias("fwd_bytes"), F.get(picked, F.lit(0)).alias("idle_min"))


@query(
    "labelled_vectors",
    f"WITH {_VEC_SQL} SELECT event_id, CASE event_type WHEN 'error' THEN 1 ELSE 0 END AS y FROM vf WHERE NOT lacking AND NOT garbled AND event_type <> 'signup'",
)
def labelled_vectors(spark, d):
    return X.labelled_vectors(vector_flows(spark, d)).select("event_id", "y")


@query(
    "class_weight",
    f"""WITH {_VEC_SQL}, y AS (SELECT CASE event_type WHEN 'error' THEN 1 ELSE 0 END AS y FROM vf WHERE NOT lacking AND NOT garbled AND event_type <> 'signup')
SELECT (count(*) - sum(y)) / CAST(sum(y) AS DOUBLE) AS weight FROM y""",
)
def class_weight(spark, d):
    return T.class_weight(X.labelled_vectors(vector_flows(spark, d)))


_EMB = "e AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings)"


@query(
    "zscore",
    f"""WITH {_EMB} SELECT vec_id, {sql_q4('(v[1] - 0.25) / 0.5')} AS a, {sql_q4('(v[64] - 0.25) / 0.5')} AS b, 0e0 AS c FROM e""",
)
def zscore(spark, d):
    e = table(spark, d, "embeddings")
    means = X.literal_vector([0.25] * 64)
    stds = X.literal_vector([0.5 if i != 7 else 0.0 for i in range(64)])
    z = e.select("vec_id", X.zscore(F.col("embedding").cast("array<double>"), means, stds).alias("z"))
    return z.select("vec_id", *[q4(F.get("z", F.lit(i))).alias(n) for i, n in ((0, "a"), (63, "b"))], F.get("z", F.lit(7)).alias("c"))


@query(
    "score_functions",
    """SELECT event_id, CASE WHEN value / 500 <= 0.1 THEN 0 ELSE least(1, (value / 500 - 0.1) / (0.9 - 0.1)) END AS scaled,
  CASE WHEN value / 500 > 0.1 THEN 1e0 ELSE 0e0 END AS step, least(1, abs(value / 500 - 0.5) * 2) AS confidence FROM (SELECT event_id, value FROM events)""".replace(
        "0.1", "CAST(0.1 AS DOUBLE)"
    ).replace("0.9", "CAST(0.9 AS DOUBLE)").replace("0.5", "CAST(0.5 AS DOUBLE)"),
)
def score_functions(spark, d):
    s = F.col("value") / 500
    return table(spark, d, "events").select(
        "event_id", S.normalize_score(s, 0.1, 0.9).alias("scaled"), S.normalize_score(s, 0.1).alias("step"),
        S.confidence(s, 0.5).alias("confidence"),
    )


@query(
    "reconstruction_error",
    f"""WITH {_EMB}, p AS (SELECT vec_id, label, v, list_transform(v, lambda x: round(x, 1)) AS r FROM e),
x AS (SELECT label, list_sum(list_transform(list_zip(v, r), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) / 64 AS error FROM p)
SELECT label, count(*) AS n, {sql_q4('avg(error) * 1000')} AS loss FROM x GROUP BY label""",
)
def reconstruction_error(spark, d):
    """Error of one-decimal rounding, averaged per label."""
    v = F.col("embedding").cast("array<double>")
    df = table(spark, d, "embeddings").withColumns({"v": v, "r": F.transform(v, lambda x: F.round(x, 1))})
    loss = T.split_loss(T.reconstruction_error(df, "v", "r"), split="label")
    return loss.withColumn("loss", q4(F.col("loss") * 1000))


# --- sequences ---------------------------------------------------------------------------
_SEQ_SQL = f"""{_VEC_SQL},
ok AS (SELECT *, row_number() OVER (PARTITION BY flow_key ORDER BY "timestamp", event_id) - 1 AS pos FROM vf WHERE NOT lacking AND NOT garbled)"""


def sequence_rows(spark, d):
    return X.strict_vector(vector_flows(spark, d)).select("event_id", "flow_key", "timestamp", "vec")


@query(
    "sliding_sequences",
    f"""WITH {_SEQ_SQL}, w AS (
  SELECT *, lead("timestamp", 9) OVER o AS last_ts, sum(value) OVER (PARTITION BY flow_key ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS total
  FROM ok WINDOW o AS (PARTITION BY flow_key ORDER BY pos))
SELECT flow_key, pos AS start_pos, "timestamp" AS first_ts, last_ts, 10 AS size, {sql_q4('total')} AS total FROM w WHERE last_ts IS NOT NULL AND pos % 2 = 0""",
)
def sliding_sequences(spark, d):
    w = Q.sliding_sequences(sequence_rows(spark, d), 10, 2, tie="event_id")
    total = F.aggregate("seq", F.lit(0.0), lambda s, v: s + F.get(v, F.lit(0)))
    return w.select("flow_key", "start_pos", "first_ts", "last_ts", F.size("seq").alias("size"), q4(total).alias("total"))


@query(
    "tumbling_sequences",
    f"""WITH {_SEQ_SQL}, w AS (SELECT flow_key, pos // 10 AS window_no, max("timestamp") AS "timestamp", count(*) AS n, sum(value) AS total FROM ok GROUP BY ALL)
SELECT flow_key, window_no, "timestamp", {sql_q4('total')} AS total FROM w WHERE n = 10""",
)
def tumbling_sequences(spark, d):
    w = Q.tumbling_sequences(sequence_rows(spark, d), 10, tie="event_id")
    total = F.aggregate("seq", F.lit(0.0), lambda s, v: s + F.get(v, F.lit(0)))
    return w.select("flow_key", "window_no", "timestamp", q4(total).alias("total"))


@query(
    "fit_normalization",
    f"""WITH {_SEQ_SQL}, s AS (SELECT flow_key, pos, lead(pos, 9) OVER (PARTITION BY flow_key ORDER BY pos) AS till FROM ok),
m AS (SELECT ok.value FROM s JOIN ok ON s.flow_key = ok.flow_key AND ok.pos BETWEEN s.pos AND s.till WHERE till IS NOT NULL),
a AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM m)
SELECT i AS position, {sql_q4('m + i')} AS mean, {sql_q4('s')} AS scale FROM a, (SELECT CAST(unnest(range(0, 51)) AS INTEGER) AS i)""",
)
def fit_normalization(spark, d):
    held = Q.window_rows(sequence_rows(spark, d), 10, tie="event_id")
    fit = T.fit_normalization(held.withColumn("seq", F.array("vec")), weight="weight")
    rows = fit.select(F.posexplode(F.arrays_zip("means", "scales")).alias("position", "p"))
    return rows.select("position", q4("p.means").alias("mean"), q4("p.scales").alias("scale"))


@query(
    "split_sequences",
    f"""WITH {_SEQ_SQL}, s AS (SELECT flow_key, pos, "timestamp" AS first_ts, lead(pos, 9) OVER (PARTITION BY flow_key ORDER BY pos) AS till FROM ok),
o AS (SELECT flow_key, pos, row_number() OVER (ORDER BY flow_key, first_ts, pos) - 1 AS i, count(*) OVER () AS n FROM s WHERE till IS NOT NULL)
SELECT flow_key, pos AS start_pos, CASE WHEN i / (n - 1) < 0.8e0 THEN 'train' WHEN i / (n - 1) < 0.8e0 + 0.1e0 THEN 'val' ELSE 'test' END AS split FROM o""",
)
def split_sequences(spark, d):
    w = Q.sliding_sequences(sequence_rows(spark, d), 10, tie="event_id").select("flow_key", "first_ts", "start_pos")
    return split_ordered(w, ties=["start_pos"]).select("flow_key", "start_pos", "split")


# --- detectors -------------------------------------------------------------------------------
def scored_flows(spark, d):
    """The 51-feature flows of the event packets, identified by flow and start."""
    df = O.flow_vector51(V.packets(spark, d), 86_400).drop("features")
    return df.withColumn("id", F.concat("flow_key", F.lit("@"), "timestamp"))


def rules(spark):
    rows = [
        ("b.yml", "r2", "Second rule", "high", True),
        ("a.yml", "r1", "First rule", "medium", True),
        ("0.yml", "r0", "Inactive rule", "low", False),
    ]
    return spark.createDataFrame(rows, "path STRING, id STRING, title STRING, level STRING, has_selection BOOLEAN")


@query(
    "first_rule",
    """WITH f AS (SELECT l_orderkey, sum(l_quantity) AS q, count(*) * 30 AS syn, min(l_linenumber) * 0.5e0 AS dur, sum(l_quantity) * 20 AS fp, sum(l_quantity) * 40 AS fb FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN hit THEN 'r1' END AS rule_id, CASE WHEN hit THEN 'First rule' END AS rule_name, CASE WHEN hit THEN 'medium' END AS rule_severity
FROM (SELECT *, (syn > 100 AND dur < 1) OR (fp > 1000 AND fb < 5000) AS hit FROM f)""",
)
def first_rule(spark, d):
    f = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        (F.count(F.lit(1)) * 30).alias("syn_flag_count"), (F.min("l_linenumber") * 0.5).alias("duration"),
        (F.sum("l_quantity") * 20).alias("fwd_packets"), (F.sum("l_quantity") * 40).alias("fwd_bytes"),
    )
    return D.first_rule(f, rules(spark)).select("l_orderkey", "rule_id", "rule_name", "rule_severity")


@query("fast_detect")
def fast_detect(spark, d):
    """Forest fitted on the flows themselves, then every flow scored."""
    # sessions are made once, for the count, the samples and the scores
    flows = stored(scored_flows(spark, d), "flows")
    trees = T.iforest_fit(X.strict_vector(flows), "id")
    out = D.fast_detect(flows, trees, rules=rules(spark), threshold=0.6, mode="high")
    return D.detection_rows(out, "fast")


@query("iforest_trees")
def iforest_trees(spark, d):
    return T.iforest_fit(X.strict_vector(stored(scored_flows(spark, d), "flows")), "id")


@query("supervised_detect")
def supervised_detect(spark, d):
    labelled = scored_flows(spark, d).withColumn("label", F.when(F.contains("flow_key", F.lit(":22/")) | F.contains("flow_key", F.lit(":22->")), "1").otherwise("0"))
    labelled = stored(labelled, "flows")
    fit = T.supervised_fit(labelled, "id", flat_ok=True)
    return D.detection_rows(D.supervised_detect(labelled, fit.model, flat_ok=True), "supervised")


@query("sequence_detect")
def sequence_detect(spark, d):
    # vectors are built once, for the fit and the windows that are scored
    rows = stored(sequence_rows(spark, d), "vectors")
    params, _ = T.sequence_fit(rows, 10, tie="event_id")
    return D.detection_rows(D.vectors_detect(rows, params, tie="event_id"), "sequence")


@query(
    "autoencoder_fit",
    f"""WITH {_VEC_SQL}, k AS (SELECT greatest(count(*) - 9, 0) AS n FROM vf WHERE NOT lacking AND NOT garbled GROUP BY flow_key),
a AS (SELECT CAST(sum(n) AS BIGINT) AS n FROM k), p AS (SELECT unnest(range(n)) / CAST(greatest(n - 1, 1) AS DOUBLE) AS pos FROM a)
SELECT CASE WHEN pos < 0.8 THEN 'train' WHEN pos < 0.9 THEN 'val' ELSE 'test' END AS split, count(*) AS n, true AS learned FROM p GROUP BY 1""",
)
def autoencoder_fit(spark, d):
    """Windows per split, and whether training brought the validation error below that of the starting weights."""
    _, loss, history = E.autoencoder_fit(stored(sequence_rows(spark, d), "vectors"), 10, tie="event_id")
    return loss.select("split", "n", F.lit(min(v for _, v in history) < history[0][1]).alias("learned"))


@query(
    "join_scores",
    f"""WITH {_SEQ_SQL}, w AS (SELECT flow_key, pos // 10 AS k, max("timestamp") AS "timestamp", sum(value) AS reconstruction_error, count(*) AS n FROM ok GROUP BY ALL)
SELECT vf.event_id, {sql_q4('w.reconstruction_error')} AS reconstruction_error FROM vf LEFT JOIN w ON vf.flow_key = w.flow_key AND vf."timestamp" = w."timestamp" AND w.n = 10""",
)
def join_scores(spark, d):
    w = Q.tumbling_sequences(stored(sequence_rows(spark, d), "vectors"), 10, tie="event_id")
    total = F.aggregate("seq", F.lit(0.0), lambda s, v: s + F.get(v, F.lit(0)))
    out = D.join_scores(vector_flows(spark, d), w.withColumn("reconstruction_error", total))
    return out.select("event_id", q4("reconstruction_error").alias("reconstruction_error"))


@query(
    "union_detections",
    """SELECT CASE event_type WHEN 'error' THEN 'deep_path_lstm_ae' WHEN 'purchase' THEN 'xgboost_supervised' ELSE 'fast_path' END AS alert_type, count(*) AS n,
  count(*) FILTER (WHERE event_type = 'error') AS with_error, count(*) FILTER (WHERE event_type = 'purchase') AS with_probability FROM events GROUP BY 1""",
)
def union_detections_query(spark, d):
    df = V.detections(spark, d)
    kinds = {"sequence": df.filter("alert_type = 'deep_path_lstm_ae'"), "supervised": df.filter("alert_type = 'xgboost_supervised'")}
    kinds["fast"] = df.filter("alert_type in ('fast_path', 'unknown')")
    parts = [D.detection_rows(part, kind) for kind, part in kinds.items()]
    both = union_detections(*parts)
    return both.groupBy("alert_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("reconstruction_error").alias("with_error"),
        F.count("anomaly_probability").alias("with_probability"),
    )
