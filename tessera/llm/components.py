"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of edges (a, b: long); component is a node of it. Loops and repeats are allowed.

    Rounds of contraction: each node takes the least id among itself and its neighbours, edges are rewritten to these ids,
    and what has become a loop goes. Minima are pre-aggregated before they are shuffled and hot nodes are left to Spark's
    skew join. Nothing but the test for emptiness reaches the driver.
    """
    now = materialize(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    rounds: list[DataFrame] = []
    while not now.isEmpty():
        ends = now.select("a", "b").union(now.select("b", "a"))
        label = ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        label = materialize(label.select("node", F.least("node", "m").alias("label")), "labels")
        left, right = label.toDF("a", "la"), label.toDF("b", "lb")
        again = now.join(left, "a").join(right, "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        now = materialize(again.filter("a <> b").distinct(), "edges")
        rounds.append(label)
    if not rounds:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = rounds[0].toDF("node", "component")
    for label in rounds[1:]:
        out = out.join(label.toDF("component", "next"), "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return materialize(out, "components")
