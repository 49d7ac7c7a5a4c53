"""Distributed connected components of an edge table.

Alternating large-star and small-star steps: each is a join of the edges with
every node's least neighbour, so no component is ever gathered in a task; the
edge table is written to the shared folder after each round. Converges in
O(log^2 nodes) rounds; links to hubs converge in two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affordspark.llm.storage import dropped, written


def _large_star(e: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of its neighbours
    and itself."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """Every node (u > v in all edges) links its smaller neighbours and itself
    to the least of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    linked = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return linked.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str, b: str, parts: int | None = None) -> DataFrame:
    """(node, component): component is the least node reachable, for every
    node that has an edge to another one. Nulls and self-edges are ignored;
    an empty edge table gives an empty result. Nodes may be of any orderable
    type. The edges of a round are written by at most parts tasks."""
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    kept = written(e, "cc", parts)
    mark = None
    while True:
        now = kept.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark or now[0] == 0:
            break
        mark = tuple(now)
        before, kept = kept, written(_small_star(_large_star(kept)), "cc", parts)
        dropped(before)
    roots = kept.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.union(kept.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
