"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stash, unstash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang every node's larger (or smaller) neighbours on its least neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = both.join(least, "u")
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, root) of every node on an edge; ``root`` is the least node of its component.

    Self-edges and edges with a null end count for nothing; repeated edges count once. Each round is written to the
    shared checkpoint folder and moves at most one row for an edge, so no node's neighbours ever meet in one task's
    memory. An empty table gives an empty result.
    """
    now = stash(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("u"), F.col(b).alias("v")).distinct())
    mark = None
    for _ in range(most):
        before, now = now, stash(_star(_star(now, True), False))
        unstash(before)
        seen = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if tuple(seen) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = tuple(seen)
    raise RuntimeError(f"components didn't settle in {most} rounds")
