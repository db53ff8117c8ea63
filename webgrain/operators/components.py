"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgrain.staging import staged


def _with_least(pairs: DataFrame, own: bool) -> DataFrame:
    """pairs (u, v) with m, the least of u's partners (and of u itself where own). Minima are combined before the
    shuffle, so a node with very many partners costs its group one row per task; the join may be split by key size."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    joined = pairs.join(least, "u")
    return joined.withColumn("m", F.least("u", "m")) if own else joined


def _settled(stars: DataFrame) -> tuple[bool, int]:
    """Whether pairs (u, v), v < u, are stars: each u has one v, and no v is a u, so that each v is its component's least;
    and the number of pairs."""
    n, distinct = stars.agg(F.count("*"), F.countDistinct("u")).collect()[0]
    return n == distinct and stars.select("v").join(stars.select(F.col("u").alias("v")), "v", "left_semi").isEmpty(), n


def connected_components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b), component being the least node that is reachable.

    Edges are undirected; loops, repeated edges and edges with a null end add nothing but, for loops, their node. Each
    round is a durable table, so a lost executor costs one round's work at most. Rounds grow with the logarithm of the
    longest path. An empty edge table has no components.
    """
    clean = edges.select(F.col("a").alias("a"), F.col("b").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    nodes = staged(clean.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    stars = nodes.where("u <> v")
    for _ in range(max_rounds):
        done, n = _settled(stars)
        if done:
            break
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, own=True).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        linked = _with_least(down, own=False)
        small = linked.select(
            F.col("v").alias("u"), F.col("m").alias("v")
        ).unionByName(linked.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        stars = staged(small, "cc-stars", rows=2 * n)  # a round makes at most two pairs of each
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    every = nodes.select("u").unionByName(nodes.select(F.col("v").alias("u"))).distinct()
    return every.join(stars.select("u", F.col("v").alias("least")), "u", "left").select(
        F.col("u").alias("node"), F.coalesce("least", "u").alias("component")
    )
