"""Bundles of similar paths: buckets, pairs, single-linkage groups, common elevations, zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import similarity as S
from netloom.operators import paths as P
from netloom.operators.components import components
from netloom.operators.ordering import numbered
from netloom.plans.tables import work_dir, written

#: Defaults of grouping.
SIMILAR, START_SPREAD, Z_TOLERANCE, TRUNK_SPREAD, BAND_FACTOR, LEAST_SIZE = 0.70, 5000.0, 200.0, 1500.0, 2.0, 2


def pairs(features: DataFrame, bucket: list[str], similarity=S.composite) -> DataFrame:
    """(bucket, a, b, similarity) of every two paths of a bucket, a < b.

    The join is on the bucket; adaptive execution splits a bucket that is larger than the others.
    """
    side = F.struct("path_id", "arrow", "steps", "range", "length", "sx", "sy")
    rows = features.select(*bucket, side.alias("path"))
    both = rows.alias("l").join(rows.alias("r"), bucket).where(F.col("l.path.path_id") < F.col("r.path.path_id"))
    a, b = F.col("l.path"), F.col("r.path")
    far = F.sqrt((a["sx"] - b["sx"]) * (a["sx"] - b["sx"]) + (a["sy"] - b["sy"]) * (a["sy"] - b["sy"]))
    return both.select(*bucket, a["path_id"].alias("a"), b["path_id"].alias("b"), F.round(similarity(a, b), 6).alias("similarity"), far.alias("start_distance"))


def mean_of_sixths(similarity: Column) -> Column:
    """Mean of values of six places, rounded half up to four in whole numbers: no order of adding changes it."""
    total, n = F.sum(F.round(similarity * 1_000_000).cast("long")), F.count(similarity)
    return F.floor((2 * total + 100 * n) / (200 * n).cast("decimal(20,0)")).cast("long") / 10_000


def groups(features: DataFrame, bucket: list[str], least: float = SIMILAR, spread: float = START_SPREAD, size: int = LEAST_SIZE) -> tuple[DataFrame, DataFrame]:
    """(groups, members): single linkage over pairs of at least `least`; groups whose starts lie too far
    apart are dropped whole. group_id orders by paths, mean similarity (of all pairs) and bucket."""
    where = work_dir(features.sparkSession)
    scored = written(pairs(features, bucket), f"{where}/pairs")
    label = components(scored.where(F.col("similarity") >= least).select("a", "b"))
    a, b = (label.select(F.col("vertex").alias(c), F.col("component").alias(f"_{c}")) for c in "ab")
    inside = scored.join(a, "a").join(b, "b").where("_a = _b")
    stats = inside.groupBy(*bucket, F.col("_a").alias("component")).agg(
        mean_of_sixths(F.col("similarity")).alias("avg_similarity"), F.round(F.max("start_distance"), 3).alias("max_start_xy_dist")
    )
    counts = label.groupBy("component").agg(F.count("*").alias("path_count"))
    found = stats.join(counts, "component").where((F.col("path_count") >= size) & (F.col("max_start_xy_dist") <= spread))
    named = numbered(found, [F.desc("path_count"), F.desc("avg_similarity"), *map(F.col, bucket), F.col("component")], "group_id")
    return named, label.join(named.select("component", "group_id"), "component").select("group_id", F.col("vertex").alias("path_id"))


def common_levels(runs: DataFrame, group: str, tolerance: float = Z_TOLERANCE, size: int = LEAST_SIZE) -> DataFrame:
    """Elevations that at least `size` paths of a group share: group, level_no, mean_z, path_count, xy_spread.

    runs: horizontal runs (group, path_id, run_no, mean_z, mean_x, mean_y).
    """
    entry = F.struct(F.col("mean_z").alias("z"), "path_id", "run_no", F.col("mean_x").alias("x"), F.col("mean_y").alias("y"))
    folded = runs.groupBy(group).agg(F.collect_list(entry).alias("v")).select(group, F.posexplode(P.running_mean_clusters(F.col("v"), tolerance)).alias("at", "c"))
    mean = F.aggregate("c", F.lit(0.0), lambda s, x: s + x["z"]) / F.size("c")
    n = F.size(F.array_distinct(F.transform("c", lambda x: x["path_id"])))
    kept = folded.select(group, "at", F.round(mean, 3).alias("mean_z"), n.cast("long").alias("path_count"), F.round(P.diameter(F.col("c")), 3).alias("xy_spread")).where(F.col("path_count") >= size)
    return kept.withColumn("level_no", F.row_number().over(Window.partitionBy(group).orderBy("at"))).drop("at")


def trunks(levels: DataFrame, group: str, spread: float = TRUNK_SPREAD) -> DataFrame:
    """group, trunk_z, is_trunk_estimated: the level of most paths among the narrow ones, else the narrowest."""
    narrow = F.col("xy_spread") <= spread
    order = [F.desc(narrow), F.desc(F.when(narrow, F.col("path_count"))), F.col("xy_spread"), F.col("level_no")]
    best = levels.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_n = 1")
    return best.select(group, F.col("mean_z").alias("trunk_z"), (~narrow).alias("is_trunk_estimated"))


def zones(points: DataFrame, trunk: DataFrame, group: str, tolerance: float = Z_TOLERANCE, factor: float = BAND_FACTOR) -> DataFrame:
    """Boxes of fan_in, trunk and fan_out of each group; points: (group, path_id, seq, x, y, z).

    The trunk of a path runs from its first to its last point within the band; a path that never enters the
    band is fan_in below it and fan_out above.
    """
    rows = points.join(trunk, group)
    in_band = F.abs(F.col("z") - F.col("trunk_z")) <= tolerance * factor
    path = Window.partitionBy("path_id")
    rows = rows.withColumns({"first": F.min(F.when(in_band, F.col("seq"))).over(path), "last": F.max(F.when(in_band, F.col("seq"))).over(path)})
    zone: Column = (
        F.when(F.col("first").isNull(), F.when(F.col("z") < F.col("trunk_z"), "fan_in").otherwise("fan_out"))
        .when(F.col("seq") < F.col("first"), "fan_in")
        .when(F.col("seq") > F.col("last"), "fan_out")
        .otherwise("trunk")
    )
    box = [f(c).alias(f"{c}_{n}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    return rows.groupBy(group, zone.alias("zone"), "trunk_z", "is_trunk_estimated").agg(*box, F.count("*").alias("node_count"))


def groups_v1(features: DataFrame, bucket: list[str], least: float = SIMILAR, spread: float = START_SPREAD, size: int = LEAST_SIZE) -> DataFrame:
    """Groups by the first version's similarity, unnumbered: bucket, component, path_count, avg_similarity,
    max_start_xy_dist and spacing (the mean start distance of all its pairs)."""
    scored = written(pairs(features, bucket, S.composite_v1), f"{work_dir(features.sparkSession)}/pairs")
    label = components(scored.where(F.col("similarity") >= least).select("a", "b"))
    a, b = (label.select(F.col("vertex").alias(c), F.col("component").alias(f"_{c}")) for c in "ab")
    inside = scored.join(a, "a").join(b, "b").where("_a = _b")
    stats = inside.groupBy(*bucket, F.col("_a").alias("component")).agg(
        mean_of_sixths(F.col("similarity")).alias("avg_similarity"), F.round(F.max("start_distance"), 1).alias("max_start_xy_dist"), F.round(F.avg("start_distance"), 1).alias("spacing")
    )
    counts = label.groupBy("component").agg(F.count("*").alias("path_count"))
    return stats.join(counts, "component").where((F.col("path_count") >= size) & (F.col("max_start_xy_dist") <= spread))


def common_levels_v1(runs: DataFrame, group: str, tolerance: float = Z_TOLERANCE, size: int = LEAST_SIZE) -> DataFrame:
    """As common_levels, but a level holds what lies within the tolerance of its lowest run."""
    entry = F.struct(F.col("mean_z").alias("v"), "path_id", "run_no", F.col("mean_x").alias("x"), F.col("mean_y").alias("y"))
    folded = runs.groupBy(group).agg(F.collect_list(entry).alias("v")).select(group, F.explode(P.anchored_groups(F.col("v"), tolerance)).alias("g"))
    rows = folded.groupBy(group, F.col("g.group").alias("at")).agg(F.collect_list("g.value").alias("c"), F.avg("g.value.v").alias("z"), F.countDistinct("g.value.path_id").alias("path_count"))
    kept = rows.where(F.col("path_count") >= size).select(group, "at", F.round("z", 1).alias("mean_z"), "path_count", F.round(P.diameter(F.col("c")), 1).alias("xy_spread"))
    return kept.withColumn("level_no", F.row_number().over(Window.partitionBy(group).orderBy("at"))).drop("at")


def zones_v1(points: DataFrame, trunk: DataFrame, group: str, tolerance: float = Z_TOLERANCE, factor: float = BAND_FACTOR) -> DataFrame:
    """Boxes of the zones by height alone: within the band trunk, below it fan_in, above it fan_out."""
    off = F.col("z") - F.col("trunk_z")
    zone = F.when(F.abs(off) <= tolerance * factor, "trunk").when(off < 0, "fan_in").otherwise("fan_out")
    box = [f(c).alias(f"{c}_{n}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    return points.join(trunk, group).groupBy(group, zone.alias("zone"), "trunk_z", "is_trunk_estimated").agg(*box, F.count("*").alias("node_count"))
