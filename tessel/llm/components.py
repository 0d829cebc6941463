"""Connected components of a link table by alternating star contraction.

Each round is two group-wise minima and two joins on the link table (large star, small star);
the rows of a round are written to shared storage, which cuts lineage, so a lost executor costs
one round at most.  Only counts reach the driver.  A node with a third of all links is met by
partial aggregation (minima) and by the planner's skew-join split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.session import materialize


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or itself)."""
    both = _both(links)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node's smaller neighbours, and the node, are linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``links (a, b)`` that is not the smallest of its
    component; ``component`` is the smallest node reachable.  Nulls and self-links are ignored.
    Raises if ``most_rounds`` do not suffice (never returns unfinished components)."""
    now = materialize(links.select("a", "b").where("a <> b").distinct(), "links")
    mark = None
    for _ in range(most_rounds):
        now = materialize(_small_star(_large_star(now)), "links")
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = seen
    raise RuntimeError(f"components not settled after {most_rounds} rounds")
