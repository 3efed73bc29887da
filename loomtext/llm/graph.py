"""Connected components of links by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._store import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs each node's larger (or smaller) neighbours on its least neighbour."""
    if large:
        near = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = near.join(least, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and comp (the least node it reaches) of every node with a link.

    ``edges`` has columns a and b of long ids. Each round is written to the
    shared folder; hot nodes are pre-aggregated, and their rows are only ever
    joined with one row.
    """
    now = written(edges.where("a <> b").select("a", "b").distinct())
    mark = None
    while True:
        now = written(_star(_star(now, True), False))
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (new := tuple(sums)) == mark:
            break
        mark = new
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return stars.union(stars.select(F.col("comp").alias("node"), "comp").distinct())
