"""The overlap graph of images: components and zero points along paths.

The graph has one node per image; its tables are small beside the detections, but they too stay DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyspark.operators.rounds import Rounds


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """nodes (node), edges (a, b) in both directions: (node, component), the smallest node that can be reached. Labels spread along edges and jump to their label's label.

    Each round reads the edges: give them as a written table, not as the plan that makes them."""
    held = Rounds(nodes.sparkSession)
    label = held.keep(nodes.select("node", F.col("node").alias("component")), "label")
    for _ in range(rounds):
        near = edges.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        spread = label.join(near, "node", "left").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = spread.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = held.keep(spread.join(jump, "component", "left").select("node", "was", F.least("component", "further").alias("component")), "label")
        label = new.drop("was")
        if new.where("was <> component").isEmpty():
            return label
    raise RuntimeError("components did not settle")


def references(sizes: DataFrame, labels: DataFrame) -> DataFrame:
    """(component, reference): the image with most matches, ties to the smaller name. sizes: (node, n)."""
    return labels.join(sizes, "node").groupBy("component").agg(F.min_by("node", F.struct(-F.col("n"), F.col("node"))).alias("reference"))


def propagate_zero_points(labels: DataFrame, refs: DataFrame, edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, zp, depth): zero points added along edges from each component's reference, level by level; of several parents at one level the smallest name counts. Each level reads the edges, as in components()."""
    held = Rounds(edges.sparkSession)
    front = held.add(refs.select(F.col("reference").alias("node"), F.lit(0.0).alias("zp"), F.lit(0).alias("depth")), "done")
    for depth in range(1, rounds):
        reach = edges.join(front.select(F.col("node").alias("a"), F.col("zp").alias("base")), "a").join(held.all("done").select(F.col("node").alias("b")), "b", "left_anti")
        front = held.add(reach.groupBy(F.col("b").alias("node")).agg(F.min_by(F.col("base") + F.col("zp"), "a").alias("zp")).withColumn("depth", F.lit(depth)), "done")
        if front.isEmpty():
            held.drop()
            return held.all("done")
    raise RuntimeError("zero points did not settle")
