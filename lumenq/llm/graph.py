"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, stage


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """node, label: the smallest node that edges (a, b) connect each node with.

    In each round every node points to its smallest neighbour (or itself), pointers are followed to their
    roots, and the graph is contracted to the roots. That at least halves its nodes, and mostly leaves almost
    no edges, so edges are read a few times only. Neighbours are only ever summed up by their minimum, so a hub is
    no larger a task than others.
    """
    graph = stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = graph.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    for _ in range(rounds):
        roots = stage(graph.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("low")), "roots")
        while True:
            follow = roots.select(F.col("a").alias("low"), F.col("low").alias("next"))
            further = stage(roots.select("a", "low").join(follow, "low").select("a", F.col("next").alias("low"), (F.col("next") < F.col("low")).alias("moved")), "roots")
            discard(roots)
            roots = further
            if not roots.where("moved").limit(1).count():
                break
        low = roots.select("a", "low")
        told = stage(labels.join(low.withColumnRenamed("a", "label"), "label", "left").select("node", F.coalesce("low", "label").alias("label")), "labels")
        ends = graph.join(low.withColumnRenamed("low", "x"), "a").join(low.select(F.col("a").alias("b"), F.col("low").alias("y")), "b")
        rest = stage(ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        discard(graph, labels, roots)
        graph, labels = rest, told
        if not graph.limit(1).count():
            discard(graph)
            return labels
    raise RuntimeError(f"the graph isn't contracted after {rounds} rounds")
