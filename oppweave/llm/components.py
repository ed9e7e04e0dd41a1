"""Connected components of a link table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import discard, stored


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``id, component`` for every node (column id): the smallest id reachable over links (columns a, b).

    Each round points every node's larger neighbours to the smallest one (large star), then its smaller ones
    (small star); the number of links never grows, and the rounds grow with the logarithm of the longest chain.
    A node with very many links is handled by grouped minima and joins back to one row per node, which
    adaptive execution splits. Every round is written to the shared folder. Ends of links that are no nodes
    join groups all the same.
    """
    edges = stored(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = None
    while True:
        large = _large_star(edges)
        small = stored(_small_star(large), "star")
        state = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        discard(edges)
        edges = small
        if tuple(state) == before:
            break
        before = tuple(state)
    joined = nodes.select("id").distinct().join(edges.select(F.col("a").alias("id"), "b"), "id", "left")
    return joined.select("id", F.coalesce("b", "id").alias("component"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (
        both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    to_least = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return to_least.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
