"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodlens.sources.tables import settle


def _pull(edges: DataFrame, larger: bool) -> DataFrame:
    """Each node hands its smallest neighbour (or itself) to its larger neighbours, or to its smaller ones and itself."""
    if larger:
        edges = edges.union(edges.select("b", "a"))
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = edges.join(least, "a")
    if larger:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
    return out.filter(F.col("a") != F.col("b")).distinct()


def roots(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Links ``(a, b)`` of integers → ``(node, root)`` for every node with a link but the roots themselves.

    The root is the smallest node of a component.

    Every round replaces links by links towards smaller nodes until all point at their root, which takes a number
    of rounds that grows with the logarithm of the longest path. Each round is written to the shared folder, so
    plans stay short and a lost executor costs one round.
    """
    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = settle(
        links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    before = state(edges)
    for _ in range(rounds):
        # Edges point from the larger to the smaller node throughout.
        edges = settle(_pull(_pull(edges, True), False), "stars")
        if (now := state(edges)) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError(f"components are not settled after {rounds} rounds")
