"""Connected components of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stepweave.session import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable from each node of ``edges`` (columns a, b; any direction, repeats allowed).

    Every round takes the smallest label of all neighbours and then jumps to that label's own label, so long chains
    shorten by half or more; each round is written, the one before deleted, and only a count comes to the driver.

    Defined cases: edges from a node to itself and edges with a null end are ignored, and nodes that only they name have no
    row; no edges give no rows.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("component"), F.lit(None).cast(both.schema["a"].dataType).alias("old")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("low"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("old"), F.least("component", "low").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("far"))
        new = cut(step.join(jump, "to").select("node", F.least("to", "far").alias("component"), "old"))
        discard(labels)
        labels = new
        if new.filter("component <> old").isEmpty():
            discard(both)
            return new.select("node", "component")
