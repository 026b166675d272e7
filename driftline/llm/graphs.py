"""Connected components of a graph given by its edges, by alternating large and small stars.

Each round links every node's larger neighbours, then its smaller ones, to the smallest node it knows; in the end each
component is a star around its smallest node. All steps are joins on nodes, of which one side has a row a node, so that
adaptive execution can split a node with very many neighbours. Rounds are written to shared storage, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v): from each u to its neighbours v; all of them (large), or the smaller ones."""
    joined = edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    return joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.filter("v = m").select("u", "v"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has but one smaller neighbour, or only larger ones."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.filter("up > 1 OR (up = 1 AND down = 1)").take(1)


def components(edges: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """node, component (its smallest node) of every node that has an edge; stored. rows: a bound of the edges, if known."""
    edges = stored(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), rows)
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        larger = stored(_star(both, large=True).distinct(), rows and 2 * rows)
        release(edges)
        edges = stored(_star(larger, large=False).distinct(), rows and 2 * rows)
        release(larger)
    out = stored(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), rows and 2 * rows)
    release(edges)
    return out
