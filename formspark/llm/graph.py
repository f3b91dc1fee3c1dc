"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: a node is a hub if it has more rows than this, and than one in HUBS of all
HEAVY = 100_000
HUBS = 1_000


def _linked(seen: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """Rows (u, v) with the least neighbour m of u.

    Rows of a hub stay where they are and get its minimum by broadcast: there are fewer hubs than
    HUBS by the bound on their size.  All other nodes have so few rows that one task may hold them.
    """
    bound = max(HEAVY, n // HUBS)
    hubs = least.where(F.col("n") > bound).select("u", F.col("m").alias("_m"))
    marked = seen.join(F.broadcast(hubs), "u", "left")
    light = marked.where("_m is null").drop("_m").join(least.where(F.col("n") <= bound).select("u", "m"), "u")
    return light.unionAll(marked.where("_m is not null").select("u", "v", F.col("_m").alias("m")))


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """One star step on n edges (a, b), a > b: links each node's neighbours to its smallest one."""
    seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        seen = seen.unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # minimum and number are combined before their shuffle
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    linked = _linked(seen, least, 2 * n)
    if large:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        out = out.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link; component is the smallest node reachable.

    edges has two columns a and b of integers or strings in any order; self-links and repeats are
    harmless, rows with a null are ignored.  Each round is cut from its lineage by a reliable
    checkpoint; the rounds grow with the logarithm of the longest chain, and only two numbers a round
    reach the driver.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") > F.col("b")).distinct()
    now, before = checkpointed(now), None
    n = now.count()
    while True:
        # a large star has no more edges than there were
        now = checkpointed(_star(_star(now, True, n), False, n))
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == before or seen[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before, n = seen, seen[0]
