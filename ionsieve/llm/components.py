"""Connected components of an edge table, by joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def _to_minimum(edges: DataFrame, larger: bool) -> DataFrame:
    """Point the neighbours of every node to the smallest of them and the node itself.

    `larger` moves only the larger neighbours; otherwise the smaller ones and the node move.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    moved = both.join(least, "a")
    if larger:
        moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        own = least.select("a", F.col("m").alias("b"))
        moved = moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own)
    return moved.where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node), for every node of `edges` (a long, b long).

    Alternates between moving larger and smaller neighbours to the least one until every component is a star: no
    centre is a neighbour of another. Long chains shorten by half in each round. Loops and repeated edges do no harm.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    while True:
        larger = _to_minimum(edges, larger=True)
        edges = written(_to_minimum(larger, larger=False).distinct(), "edges")
        centres = edges.select(F.col("b").alias("a")).distinct()
        if edges.join(centres, "a", "left_semi").isEmpty():
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
