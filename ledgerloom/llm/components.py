"""Connected components by alternating stars, as joins and aggregations only.

Large star: every neighbour larger than a node is tied to the smallest node around. Small star:
the smaller ones likewise. The edges end as one star for each component. Minima are pre-aggregated
and staged, so that a join on a node with very many neighbours can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import staged


def _is_stars(edges: DataFrame) -> bool:
    ends = edges.select(F.col("high").alias("node"), F.lit(1).alias("tied"), F.lit(0).alias("centre")).unionByName(
        edges.select(F.col("low").alias("node"), F.lit(0).alias("tied"), F.lit(1).alias("centre")))
    odd = ends.groupBy("node").agg(F.sum("tied").alias("tied"), F.max("centre").alias("centre")).filter("tied > 1 OR tied + centre > 1")
    return odd.isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node of its component) for every node of a link between two different nodes."""
    edges = staged(links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct(), "edges")
    while not _is_stars(edges):
        both = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
        least = staged(both.groupBy("high").agg(F.min("low").alias("least")).select(F.col("high").alias("node"), F.least("high", "least").alias("least")), "least")
        large = staged(edges.join(least, F.col("low") == F.col("node")).select("high", F.col("least").alias("low"))
                       .filter("high != low").distinct(), "large")
        least = staged(large.groupBy("high").agg(F.min("low").alias("least")).select(F.col("high").alias("node"), "least"), "least")
        tied = large.join(least, F.col("high") == F.col("node")).select(F.col("low").alias("high"), F.col("least").alias("low")).filter("high != low")
        edges = staged(tied.unionByName(least.select(F.col("node").alias("high"), F.col("least").alias("low"))).distinct(), "edges")
    return edges.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(
        edges.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())
