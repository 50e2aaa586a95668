"""Connected components by contraction, all of it joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.runtime import table


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); component is the smallest node reachable.

    Each round points every node at its smallest neighbour, follows that pointer twice more and
    contracts the edges; a star of any size collapses in one round and a path in a logarithmic
    number of them. Grouped minima are combined before the shuffle, so a node with very many edges
    sends one row from each task. Tables of every round are written to the shared folder.
    """
    edges = table(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label = None
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        near = table(near.select("node", F.least("node", "to").alias("to")))
        for _ in range(2):
            hop = near.select(F.col("node").alias("to"), F.col("to").alias("next"))
            near = near.join(hop, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
        near = table(near)
        if label is None:
            label = near
        else:
            step = near.select(F.col("node").alias("to"), F.col("to").alias("next"))
            label = table(label.join(step, "to", "left").select("node", F.coalesce("next", "to").alias("to")))
        at = lambda side: near.select(F.col("node").alias(side), F.col("to").alias(f"{side}_to"))
        moved = edges.join(at("a"), "a").join(at("b"), "b").filter("a_to <> b_to")
        edges = table(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
    if label is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return label.withColumnRenamed("to", "component")
