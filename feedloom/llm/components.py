"""Connected components of a link table, in Spark joins only."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from feedloom.session import stored


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of a component except its root, which is the least node.

    Rounds of large star and small star: first every node sends its greater neighbours to its least one, then every node
    sends its lesser neighbours there. Minima are aggregated on the map side, so a node with many links is no hot key.
    Each round is written, which cuts the lineage.
    """
    links = stored(edges.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = _checksum(links)
    while mark[0]:
        both = links.select(F.col("u").alias("x"), F.col("v").alias("y")).union(links.select("v", "u"))
        # Written, so that the join reads it by an exchange of its own and Spark can split the links of a hot node.
        least = stored(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")))
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(below).filter("u != v")
        links, before = stored(small.distinct()), mark
        mark = _checksum(links)
        if mark == before:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
