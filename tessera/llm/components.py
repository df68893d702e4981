"""Connected components of a graph of links, by alternating large and small stars; no node's links are ever gathered in one task.

Each round replaces links by links to the least neighbour, found by a pre-aggregated minimum and a join that adaptive execution
may split at hot nodes. A round's links are written to the shared folder, and the ones before are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut, forget, fresh_path


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (u, v), both ways for a large star; v's of each u go to u's least neighbour."""
    least = links.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
    joined = links.join(least, "u")
    out = joined.where(F.col("v") > F.col("u")) if large else joined
    moved = out.select(F.col("v").alias("u"), F.col("least").alias("v"))
    if not large:
        moved = moved.unionByName(least.select("u", F.col("least").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (its least reachable node) for every node that has a link to another node."""
    spark = links.sparkSession
    edges = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where(F.col("u") != F.col("v")).distinct()
    path = fresh_path(spark, "links")
    edges = cut(edges, "links", path)
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, True)
        ordered = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _star(ordered, False)
        new_path = fresh_path(spark, "links")
        edges = cut(small, "links", new_path)
        forget(spark, path)
        path, now = new_path, mark(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
