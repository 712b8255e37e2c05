"""Connected components of a large graph by alternating stars.

A vertex is a number. In a large star every vertex ties its larger neighbours to its smallest neighbour; in a
small star it ties its smaller neighbours and itself to it. Both keep the components and end in a star around
each component's smallest vertex. Every step groups by vertex with partial aggregation, and is written out, so
neither lineage nor any one task grows. What a hub's neighbours have to know, its smallest neighbour, goes to all
tasks; there are at most twice ``HOT_KEYS`` hubs, whatever the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, hot_limit, stored


def _star(edges: DataFrame, large: bool, limit: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("times")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"), "times")
    hubs, others = F.broadcast(least.where(F.col("times") > limit)), least.where(F.col("times") <= limit)
    tied = both.join(hubs, both.u == hubs.x).unionByName(both.join(hubs, both.u == hubs.x, "left_anti").join(others, both.u == others.x))
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v")))
    return stored(out.where("u != v").distinct())


def _is_star(edges: DataFrame) -> bool:
    """Whether every vertex is either a root or tied to one root: nothing is left to do."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex of the edges (u, v); a root is the smallest vertex of its component, and its own too."""
    edges = stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    limit = hot_limit(edges.count())
    while not _is_star(edges):
        wide = _star(edges, True, limit)
        forget(edges)
        edges = _star(wide, False, limit)
        forget(wide)
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
