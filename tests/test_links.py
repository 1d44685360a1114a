import random

from pyspark.sql import functions as F

from flowspark.functions import alerts as A
from flowspark.operators import alerts as O


def test_threshold_acts_in_the_choice(spark):
    rng = random.Random(3)
    rows = [(i, f"f{rng.randrange(12)}" if rng.random() < 0.8 else "", rng.choice(["s0", "s1", None]), f"d{rng.randrange(4)}", rng.choice([0, 22, 80]), rng.choice([6, 17, None]), rng.randrange(9000)) for i in range(60)]
    df = spark.createDataFrame(rows, "n int, flow_key string, src_ip string, dst_ip string, dst_port int, protocol int, s int")
    df = df.withColumn("timestamp", F.col("s") + F.lit(1.7e9)).drop("s")
    me = F.struct(*[F.col(f) for f in A.CORRELATION_FIELDS], F.col("n").alias("id"))
    one = O.with_micros(df).select(me.alias("a"))
    pairs = one.crossJoin(one.select(F.col("a").alias("b"))).select("a", "b", A.correlation_score(F.col("a"), F.col("b")).alias("score")).collect()
    for least, window in ((0.0, 3600), (0.12, 3600), (0.2, 3600), (0.12, 7000)):
        near, total = {}, {}
        for a, b, score in pairs:
            if (b.ts_us, b.id) >= (a.ts_us, a.id) or a.ts_us - b.ts_us > window * 10**6 or score < least:
                continue
            same = {k: bool(a[k]) and a[k] == b[k] for k in ("flow_key", "src_ip", "dst_ip")}
            for kind, keys in O.LINK_KEYS.items():
                if all(same[k] for k in keys):
                    near[a.id, kind] = max(near.get((a.id, kind), (0, 0)), (b.ts_us, b.id))
            if any(same.values()):
                n, best = total.get(a.id, (0, 0))
                total[a.id] = (n + 1, max(best, score))
        got = O.correlation_links(df, window, least, tie="n").collect()
        assert sorted((r.alert, r.linked_to) for r in got) == sorted({(i, b[1]) for (i, _), b in near.items()})
        assert {r.alert: (r.n_related, r.best_score) for r in O.correlation_counts(df, window, least, tie="n").collect()} == total
