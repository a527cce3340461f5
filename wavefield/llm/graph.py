"""Connected components of a link table by alternating star contraction.

A round makes every node point at the smallest node it knows, from the larger neighbours' side and
then from the smaller ones'; rounds grow with the logarithm of a component's size. Each step is an
aggregation with partial sums and an equi-join, so that a node with very many links is no burden, and
each round is written to the shared folder: a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavefield.llm.common import discard, stored

MAX_ROUNDS = 60


def _round(edges: DataFrame) -> DataFrame:
    """edges: u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
    kept = small.where(F.col("v") == F.col("m")).select("u", "v")
    moved = small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.unionByName(moved).distinct()


def _is_done(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour and none of those has one itself."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    sums = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return sums.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) of every node with a link to another: root is the smallest node it is connected to.
    Nodes may be of any type that has an order; nulls and self-links are left out."""
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = stored(edges, "links")
    for _ in range(MAX_ROUNDS):
        if _is_done(edges):
            roots = edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)
        before, edges = edges, stored(_round(edges), "links")
        discard(before)
    raise RuntimeError("components did not settle")
