"""Connected components of a table of links, by alternating stars.

Each round is two aggregations by node and two joins on the node; nodes with very many
links are joined by broadcast, so no task holds all links of a node. Nothing is collected
to the driver but a count and a checksum. Rounds end when a round changes no link.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import cut, join_hot


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum of the links."""
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return join_hot(both.where("v > u"), least, ["u"], "n", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Links point from the larger to the smaller node."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return join_hot(edges, least, ["u"], "n", n).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every linked node; component is the smallest node.

    Links with a null end and links of a node to itself count for nothing;
    repeated links count once; no links give an empty result.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges = cut(edges)
    before = _mark(edges)
    while before[0]:
        large = cut(_large_star(edges, before[0]).distinct())
        edges = cut(_small_star(large, before[0]).where("u <> v").distinct())
        after = _mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
