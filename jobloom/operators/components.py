"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.session import written


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) for the nodes of edges (a, b), any ordered type; the component is its smallest node.

    Every round takes the smallest label among the neighbours and then jumps to that label's own label, so long chains
    shrink by halves. Labels are written to the shared folder each round; nothing is collected but a count of changes.
    Raises if the labels still change after so many rounds. Loops and repeated edges are allowed; no edges, no rows.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component"))
    labels = written(labels, "labels")
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.least("component", "near").alias("low"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("lower"))
        new = written(step.join(jump, "low", "left").select("node", F.least("low", "lower").alias("component"), "old"), "labels")
        changed = new.where("component <> old").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")
