"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shiftlens.session import cut_lineage


def smallest_neighbour(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest id among ``u`` and its neighbours; combines before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    return (
        both.join(smallest_neighbour(both), "u")
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = smallest_neighbour(down)
    moved = (
        down.join(lowest, "u").where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    )
    return moved.union(lowest.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (columns a, b); component is the smallest id.

    Each round replaces the links by stars around smaller ids until nothing changes; the number
    of rounds grows with the logarithm of the longest chain.  No list of neighbours is ever
    gathered, so a hub with any number of links is a skewed join at most.
    """
    edges = links.where(F.col("a") != F.col("b")).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
    edges, mark = cut_lineage(edges), None
    while True:
        edges = cut_lineage(small_star(large_star(edges)))
        now = edges.agg(F.count("u"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark or now[0] == 0:
            break
        mark = now
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return found.union(found.select("component", "component").distinct())
