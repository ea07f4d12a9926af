"""Routes in three stages along a bundle's trunk: to the trunk, along it, and on to the destination.

Steps are arrays of struct<dx, dy, dz>; route_blocks works them out in numpy.
requests: request_id, sx..sz, tx..tz, trunk_z (null without a trunk), steps and points of the template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import geometry as G
from netloom.operators import route_blocks as Rb

def zone_routes(requests: DataFrame, boxes: DataFrame) -> DataFrame:
    """request_id, route, detours, length and arrow of each request.

    The first DETOURS steps that meet a structural column (widened by CLEARANCE) become three: aside by half the column's
    side and MARGIN, along, and back; vertical steps and fittings pass. Of several columns the nearest to the step's start
    counts. Steps are added where the route misses the destination, and short ones join the one before of their kind.
    """
    return Rb.zone_routes(requests, boxes).select("request_id", "route", "detours", "length", "arrow")


def crosses_itself(points: Column) -> Column:
    """Whether two inner points of a path are equal after rounding."""
    inner = F.transform(F.slice(points, F.lit(2), F.greatest(F.size(points) - 2, F.lit(0))), lambda p: F.struct(*(F.round(p[c]).alias(c) for c in "xyz")))
    return F.size(F.array_distinct(inner)) < F.size(inner)


def zone_compliance(low: dict[str, Column], high: dict[str, Column], trunk_low: dict[str, Column], trunk_high: dict[str, Column], margin: float = 1.5) -> Column:
    """1 less half of what a path's box lies beyond the widened trunk, by axis; 0.5 without a trunk."""
    score = F.lit(1.0)
    for c in "xy":
        span = F.when(trunk_high[c] - trunk_low[c] == 0, 1000.0).otherwise(trunk_high[c] - trunk_low[c])
        over = F.greatest(trunk_low[c] - span * (margin - 1) - low[c], high[c] - trunk_high[c] - span * (margin - 1), F.lit(0.0))
        score = score - 0.5 * G.clamp01(over / span)
    return F.coalesce(G.clamp01(score), F.lit(0.5))


def best_group(requests: DataFrame, members: DataFrame, near: float = 8000.0) -> DataFrame:
    """request_id, group_id, score, fallback of the first version: mean similarity times log2(paths + 1), less
    the nearer start's distance; without a group of equal attributes one of the equipment at half the score.

    members: group_id, equipment, utility, size, avg_similarity, path_count, sx, sy, one row a path.
    """
    q = requests.select("request_id", "equipment", F.col("utility").alias("_u"), F.col("size").alias("_s"), F.col("sx").alias("_x"), F.col("sy").alias("_y"))
    far = F.sqrt((F.col("sx") - F.col("_x")) * (F.col("sx") - F.col("_x")) + (F.col("sy") - F.col("_y")) * (F.col("sy") - F.col("_y")))
    met = q.join(members, "equipment").withColumn("far", far).groupBy("request_id", "group_id", (F.col("utility") == F.col("_u")).alias("u"), (F.col("size") == F.col("_s")).alias("s"), "avg_similarity", "path_count").agg(F.min("far").alias("far"))
    base = F.col("avg_similarity") * F.log2(F.col("path_count") + 1.0)
    same = F.col("u") & F.col("s") & (F.col("far") <= near)
    scored = met.where(same | (F.col("far") <= 1.5 * near)).withColumns({"fallback": ~same, "score": F.when(same, base * G.clamp01(1 - F.col("far") / near)).otherwise(base * 0.5)})
    first = Window.partitionBy("request_id").orderBy("fallback", F.desc("score"), "group_id")
    return scored.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("request_id", "group_id", F.round("score", 6).alias("score"), "fallback")


def representative(chosen: DataFrame, members: DataFrame) -> DataFrame:
    """request_id, path_id, score: the path of a request's group most like it in displacement (.4), start (.3)
    and length (.3; a route is taken for 2.5 times the straight line).

    chosen: request_id, group_id, sx..sz, tx..tz; members: group_id, path_id, px, py, dx, dy, dz, length.
    """
    rows = chosen.join(members, "group_id")
    want = {c: F.col(f"t{c}") - F.col(f"s{c}") for c in "xyz"}
    straight, own = G.length3(*want.values()), G.length3(F.col("dx"), F.col("dy"), F.col("dz"))
    cosine = F.when((straight < 1e-9) & (own < 1e-9), 1.0).when((straight < 1e-9) | (own < 1e-9), 0.0).otherwise(G.clamp01(sum((want[c] * F.col(f"d{c}") for c in "xyz"), F.lit(0.0)) / (straight * own)))
    far = F.sqrt((F.col("sx") - F.col("px")) * (F.col("sx") - F.col("px")) + (F.col("sy") - F.col("py")) * (F.col("sy") - F.col("py")))
    rows = rows.withColumns({"_far": far, "_cos": cosine, "_len": 2.5 * straight})
    most = F.max("_far").over(Window.partitionBy("request_id"))
    length = G.clamp01(1 - F.abs(F.col("length") - F.col("_len")) / F.greatest("length", "_len", F.lit(1.0)))
    rows = rows.withColumn("score", F.round(0.4 * F.col("_cos") + 0.3 * G.clamp01(1 - F.col("_far") / F.greatest(most, F.lit(1.0))) + 0.3 * length, 6))
    first = Window.partitionBy("request_id").orderBy(F.desc("score"), "path_id")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("request_id", "path_id", "score")
