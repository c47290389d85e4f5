"""Connected components over a table of links (distributed union-find).

Built-in DataFrame operations only.  Each round hooks every vertex onto the
smallest vertex among its neighbours and itself (large star, then small star),
so paths shrink to stars; the rounds stop when all links are stars, after about
log(n) of them.  The links of a round are written to the shared checkpoint
folder, which cuts the lineage and survives lost executors.  Minima are summed up
before the shuffle, so a vertex with very many links is no hot group; no list of
neighbours is ever built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtrace.llm.common import materialise


#: Links that a task of a round takes; fewer links are not dealt to as many tasks (and files) as there are shuffle partitions.
TASK_LINKS = 1 << 16


def _both(links: DataFrame) -> DataFrame:
    """Every link from both of its ends."""
    ends = F.explode(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    return links.select(ends.alias("l")).select("l.u", "l.v")


def _star(links: DataFrame) -> DataFrame:
    """Hook both ends of every link onto the smallest vertex that either end knows.

    ``links`` has u > v.  A large star sends each neighbour above a vertex to the
    least neighbour of that vertex, a small star each neighbour below.
    """
    both = _both(links)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # the link (u, v) with v < u, seen from v
    large = (links.select(F.col("v").alias("w"), F.col("u").alias("far")).join(least, F.col("w") == F.col("u")).select(F.col("far").alias("u"), F.col("m").alias("v"))
             .union(least.filter("m < u").select("u", F.col("m").alias("v"))))
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    # a vertex hooks onto its least neighbour, and so does every other neighbour below it
    small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("l"))
    return small.select("l.u", "l.v").filter("u > v").distinct()


def _stars(links: DataFrame) -> bool:
    """Whether every vertex with a link down has no other link."""
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("down")))).alias("e"))
    seen = ends.groupBy("e.x").agg(F.sum("e.down").alias("down"), F.min("e.down").alias("least"))
    return seen.filter("down > 1 or (down = 1 and least = 0)").isEmpty()


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``vertex`` and ``root`` (the least vertex of its component) for every vertex that has a link.

    Links may be repeated, turned round or join a vertex to itself; rows with a
    null end are ignored.  No links give no rows.
    """
    now = materialise(links.select(F.col(u).alias("a"), F.col(v).alias("b")).filter("a <> b")
                      .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        now = now.coalesce(now.count() // TASK_LINKS + 1)
        if _stars(now):
            break
        now = materialise(_star(now))
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
