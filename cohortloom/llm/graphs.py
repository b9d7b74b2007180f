"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.session import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node.

    Each round points nodes at the smallest node in reach, once over all neighbours and once over smaller
    ones, until every component is a star. A node's neighbours are never gathered in one place: minima are
    combined before the shuffle and joined back. Rounds grow with the logarithm of a component's width; each
    is written to the shared folder, and only a count and a checksum reach the driver.
    """
    stars = cut_lineage(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = _state(stars)
    while True:
        nxt = cut_lineage(_small_star(_large_star(stars)))
        after = _state(nxt)
        if after == state:
            return nxt.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                nxt.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        stars, state = nxt, after


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(
        F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").where(F.col("v") != F.col("m")).select(
        F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()
