"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.common import discard, materialize


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): for each end of an edge (a, b) the smallest id that it is connected with.

    A round takes the least label among a node's neighbours, then the label of that label; both are
    joins and a minimum that combines before its shuffle, so a node with very many neighbours is
    spread over tasks. Labels are written after each round. Raises if ``max_rounds`` don't suffice.
    """
    links = edges.select("a", "b").where("a <> b")
    links = materialize(links.union(links.select("b", "a")).toDF("a", "b"))
    labels = materialize(links.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("component")))
    for _ in range(max_rounds):
        jumped = labels.alias("x").join(labels.alias("y"), F.col("x.component") == F.col("y.id"), "left")
        jumped = jumped.select(F.col("x.id").alias("id"), F.least("x.component", "y.component").alias("component"))
        offered = links.join(jumped, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("offer"))
        new = jumped.join(offered, F.col("id") == F.col("a"), "left").select("id", F.least("component", "offer").alias("component"))
        new = materialize(new)
        moved = new.alias("n").join(labels.alias("o"), "id").where("n.component <> o.component").limit(1).count()
        discard(labels)
        labels = new
        if not moved:
            discard(links)
            return labels
    raise RuntimeError(f"components have not settled in {max_rounds} rounds")
