"""Connected components of an edge list that never leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyspark.llm import common as C


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """edges: (u, v), of any ordered type. (node, root) of every node that has an edge; root is one of its component's nodes.

    Each round every node takes its smallest neighbour (or itself) as label and the edges are contracted to labels, until none is left;
    then labels are followed. Ids are expected to be hashes, so their order is random and each round removes a constant share of the edges; a star
    goes in one. Minima are aggregated before they are joined back, so a node with many edges is no single task's."""
    held = C.Scratch()
    now = held.stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    labels: DataFrame | None = None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        small = held.stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")), "labels")
        if labels is None:
            labels = small
        else:
            step = small.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = held.stored(labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
        a, b = small.select(F.col("node").alias("u"), F.col("root").alias("a")), small.select(F.col("node").alias("v"), F.col("root").alias("b"))
        left = now.join(a, "u").join(b, "v").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        now = held.stored(left, "edges")
        if now.isEmpty():
            held.clear(labels)
            return labels
        held.clear(now, labels)
    raise RuntimeError(f"components did not settle in {most} rounds")
