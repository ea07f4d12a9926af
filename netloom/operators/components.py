"""Connected components of an edge table by alternating large and small stars.

Every round rewrites the edges so that each vertex points at the least vertex around it; after a number of
rounds that grows with the logarithm of a component's size, all edges are (vertex, least vertex). Rounds are
two groupings with partial aggregation and joins that adaptive execution may split at hubs; each round is
written, so that the plan doesn't grow and a lost executor costs one round at most. Vertices may have any
orderable type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.plans.tables import dropped, work_dir, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (a, b) with a > b. Large star: around all neighbours; small star: around smaller ones."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = near.join(least, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def components(edges: DataFrame, left: str = "a", right: str = "b", rounds: int = 60) -> DataFrame:
    """(vertex, component) for every vertex of an edge between two different vertices."""
    spark = edges.sparkSession
    where = work_dir(spark)
    u, v = F.col(left), F.col(right)
    now = written(edges.where(u != v).select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).distinct(), f"{where}/0")
    before = None
    for k in range(1, rounds + 1):
        now = written(_star(_star(now, True), False), f"{where}/{k}")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
        dropped(spark, f"{where}/{k - 1}")
    else:
        raise RuntimeError(f"components: not stable after {rounds} rounds")
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
    )
