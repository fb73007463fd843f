"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut

#: A node with more neighbours than this, and than the HUB-th part of all edges, gets its new neighbour by a broadcast.
CROWDED, HUB = 1_000, 1_000


def pointed(rows: DataFrame, least: DataFrame, limit: int | None) -> DataFrame:
    """``rows`` (u, v) joined with ``least`` (u, m, n). Hubs, those with n over ``limit``, are 2 * HUB at most and joined by a broadcast, so
    their neighbours stay where they are; None where there are none."""
    if limit is None:
        return rows.join(least.select("u", "m"), "u")
    hubs = F.broadcast(least.where(F.col("n") > limit).select("u", "m"))
    return rows.join(hubs, "u").unionByName(rows.join(hubs.select("u"), "u", "left_anti").join(least.select("u", "m"), "u"))


def state(edges: DataFrame) -> tuple[bool, int | None]:
    """Is each tree a star: no node below another has a node below itself, or two above? And from how many neighbours on a node is
    a hub, None if there is no hub."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"), F.count("*").alias("n"))
    of = nodes.agg(F.coalesce(F.max(F.expr("up > 1 OR up = 1 AND down = 1")), F.lit(False)).alias("moves"), F.coalesce(F.sum("up"), F.lit(0)).alias("edges"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    limit = max(CROWDED, of["edges"] // HUB)
    return not of["moves"], limit if of["most"] > limit else None


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for every node of ``edges`` (a, b: longs); a view of one written table.

    Each round is one large-star and one small-star step (Kiveris et al. 2014). They keep connectivity and make every
    tree a star in a number of rounds that grows with the logarithm of its size; both are
    plain aggregations and joins on the node. A hub of many neighbours is met by a combined minimum and a broadcast, and
    never gathered in one task. Each round is written to the shared folder, where the next replaces it.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        done, limit = state(now)
        if done:
            break
        # large star: neighbours above u go to the least of u and its neighbours
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = pointed(both.where("v > u"), least, limit).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours below u, and u itself, go to the least of them; they are not more than u's neighbours before
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = pointed(large, low, limit).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop_cut(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
