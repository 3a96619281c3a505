"""Connected components of an edge table by alternating large-star and small-star rounds.

Both rounds are joins and partial aggregations.  Aggregates are written to the shared folder before they are
joined, so a node with very many neighbours is combined map-side, and in the join its rows are a plain shuffle
that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` (a long, b long) -> (node, component): component is the smallest node reachable.

    Self-loops and repeated edges are harmless; nulls are dropped; no edges give an empty table.
    """
    edges = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = written(edges.distinct(), "cc-edges")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "cc-least")
        # large star: every larger neighbour of u moves to u's smallest neighbour (or u)
        large = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).join(least.withColumnRenamed("a", "u"), "u")
        large = written(large.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct(), "cc-large")
        # small star: u and its smaller neighbours move to the smallest of them
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "cc-least")
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = written(small.where("a != b").distinct(), "cc-edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
