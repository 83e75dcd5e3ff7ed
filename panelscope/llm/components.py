"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.llm.common import kept


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the least of u and its neighbours."""
    both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the least of them."""
    least = _least(edges)
    others = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has either one lesser neighbour or none but larger ones, so that components can be read off."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")), F.struct(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    each = edges.select(F.explode(ends).alias("end")).groupBy("end.node").agg((F.sum("end.below") + F.max("end.above")).alias("n"))
    return (each.agg(F.max("n")).first()[0] or 0) <= 1


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v) but the roots themselves, with the least node of its component as root.

    Self-loops and nulls are ignored; an empty edge table gives an empty result. Each round is a
    grouping and a join on node keys, and is written to the shared folder; rounds grow with the
    logarithm of the longest path, and end once stars are left, as every job costs the driver memory.
    No group is collected.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = kept(edges)
    while not _are_stars(edges):
        edges = kept(_small_star(_large_star(edges)))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def connected_components(edges: DataFrame) -> DataFrame:
    """roots(), and a row for each root."""
    found = roots(edges)
    return found.union(found.select("root", "root").distinct())
