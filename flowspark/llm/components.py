"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.salted import salted_join
from flowspark.llm.shared import written


def _ends(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest of each node and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): component is the smallest node of the connected component; nodes without an edge are not listed.

    Alternating stars: first every larger neighbour, then every neighbour that isn't larger, is tied to the smallest one
    around its node, until every node is tied to the smallest of its component. The number of rounds grows with the
    logarithm of the longest path. Edges stay tables in the shared folder; the driver sees counts only.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    now = written(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = _ends(now)
        large = salted_join(both.filter("v > u"), _least(both), ["u"], F.col("v"), "inner", 8)
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = large.select("u", "v")  # u > v holds for every row
        least = small.groupBy("u").agg(F.min("v").alias("m"))
        tied = small.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), "m").filter("u <> m")
        now = written(tied.select("u", F.col("m").alias("v")).distinct(), "edges")
        before, state = state, now.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        if state == before:
            break
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
