"""Connected components by label propagation with pointer jumping.

Labels are the smallest node of a component. Edges are first contracted to stars: each node keeps the smallest of
its smaller neighbours, and its other smaller neighbours get an edge to that one, which many nodes have in common;
so a group that met in many places has about one edge a member. Every round takes the least label among neighbours
(combined before the shuffle) and then the label's own label, so chains shrink by half. Where a root has very many
members, its rows in the two joins lie on the side with many rows a key, next to one row, and both sides come straight
from a shuffle: the form that adaptive execution splits. Rounds are written to the shared folder; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialize, release


def contract(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with a > b that join the same nodes: from each node to its least smaller neighbour, and from the others of these to that one."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    root = pairs.groupBy("a").agg(F.min("b").alias("root"))
    met = pairs.join(root, "a")
    return met.select(F.explode(F.array(F.struct("a", F.col("root").alias("b")), F.struct(F.col("b").alias("a"), F.col("root").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """``edges`` (a, b), any direction, repeats allowed, to (node, label) for each node that has an edge."""
    pairs = materialize(contract(edges), tag)
    both = materialize(pairs.union(pairs.select("b", "a")), tag)
    release(pairs)
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), tag)
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("hop"))
        own = labels.select(F.col("node").alias("hop"), F.col("label").alias("beyond"))
        after = materialize(step.join(own, "hop").select("node", "old", F.least("hop", "beyond").alias("label")), tag)
        changed = after.where("old <> label").limit(1).count()
        release(labels)
        labels = after.select("node", "label")
        if not changed:
            release(both)
            return labels
