"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs(u, v): link each of u's neighbours (large: those above u; else those below, and u) to the least one."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = pairs.join(least, "u")
    if large:
        return linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        least.select("u", F.col("m").alias("v"))
    )


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("u") != F.col("v")).distinct().checkpoint()


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(h)).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b), longs in any order -> (node, root): root is the least node that node reaches.

    Nodes without an edge to another node are left out. Null ends are ignored. Each step is a
    partial aggregation and a join on one node, which AQE can split when a hub is hot; lineage is
    cut with checkpoint(). Nothing but a count and a checksum reaches the driver.
    """
    shared_dir(edges.sparkSession)
    a, b = F.col("a"), F.col("b")
    e = _clean(edges.where(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    mark = _mark(e)
    while mark[0]:
        e = _clean(_star(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), True))
        e = _clean(_star(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False))
        now = _mark(e)
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
