"""Connected components by alternating large-star and small-star, as joins and aggregates over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges(u, v), u > v. The least neighbour of a node is pre-aggregated, so a hub is no hot group.

    Large: every neighbour above the node is linked to the least of its neighbourhood. Small: the same for the node and
    its neighbours below.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    links = both if large else edges
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = links.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") > F.col("v"))


def components(edges: DataFrame, most_steps: int = 40) -> DataFrame:
    """(id, component) for each end of edges(a, b): component is the least id reachable.

    Null ends, loops and repeated edges don't matter; no edges give no rows. Two numbers a step reach the driver.
    """
    now = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(most_steps):
        after = stored(star(star(now, True).distinct(), False).distinct(), "edges")
        state = tuple(after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop_stored(now)
        now = after
        if state == seen or state[0] == 0:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select(F.col("v").alias("id"), F.col("v").alias("component")))
