"""Connected components by alternating large-star and small-star (Kiveris and others, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurlake.llm.common import dropped, written


def large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of each node to the least node around it."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    up = both.where("v > u").join(least, "u")
    return up.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.where("u <> v").unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def mark(edges: DataFrame) -> tuple:
    """Tells one set of edges from another."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges`` (``u, v`` bigint) but the roots: the least node that it is joined to.

    Loops and repeated edges change nothing; no edges give no rows. The least neighbour of a node is a grouped minimum,
    so a hub's edges are combined where they are before they meet. Each round is written to the shared folder, so a
    round's loss of an executor doesn't reach back to the edges' origin, and the one before is deleted; it ends when a
    round changes nothing."""
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    was = mark(now)
    while True:
        before, now = now, written(small_star(large_star(now)), "edges")
        dropped(before)
        if (is_ := mark(now)) == was:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        was = is_
