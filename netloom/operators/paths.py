"""Features of paths. Steps are (path_id, seq, dx, dy, dz); a path's work never leaves its partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import geometry as G


def coded(steps: DataFrame, **variant) -> DataFrame:
    """Adds len and code."""
    d = [F.col(c) for c in ("dx", "dy", "dz")]
    return steps.withColumns({"len": G.length3(*d), "code": G.segment_code(*d, **variant)})


def features(steps: DataFrame, paths: DataFrame) -> DataFrame:
    """paths with steps, points, arrow, length, box, range and spread; paths without steps are dropped.

    Running sums come from a window on the path, and the grouping on the path uses its partitioning, so steps
    are shuffled once.
    """
    by = Window.partitionBy("path_id").orderBy("seq")
    sums = {f"c{c}": F.sum(f"d{c}").over(by.rowsBetween(Window.unboundedPreceding, 0)) for c in "xyz"}
    rows = coded(steps).withColumns(sums)
    entry = F.struct("seq", "dx", "dy", "dz", "len", "code", "cx", "cy", "cz")
    ends = {f"{n}_{c}": f(f"c{c}") for c in "xyz" for n, f in (("low", F.min), ("high", F.max))}
    one = rows.groupBy("path_id").agg(F.array_sort(F.collect_list(entry)).alias("_s"), F.sum("len").alias("length"), *(v.alias(k) for k, v in ends.items()))
    out = paths.join(one, "path_id")
    start = [F.col(f"s{c}") for c in "xyz"]
    point = lambda v: F.struct(*(x.alias(c) for c, x in zip("xyz", v)))
    low, high = ({c: F.col(f"s{c}") + how(F.lit(0.0), f"{n}_{c}") for c in "xyz"} for n, how in (("low", F.least), ("high", F.greatest)))
    out = out.withColumns({
        "steps": F.transform("_s", lambda s: F.struct(s["dx"], s["dy"], s["dz"], s["len"], s["code"])),
        "points": F.concat(F.array(point(start)), F.transform("_s", lambda s: point([a + s[f"c{c}"] for a, c in zip(start, "xyz")]))),
        "arrow": F.array_join(F.transform("_s", lambda s: s["code"]), ""),
        **{f"{c}_{n}": side[c] for c in "xyz" for n, side in (("min", low), ("max", high))},
    })
    span = F.struct(*((F.col(f"{c}_max") - F.col(f"{c}_min")).alias(c) for c in "xyz"))
    return out.withColumns({"range": span, "xy_spread": diameter(F.col("points"))}).drop("_s", *ends)


def diameter(points: Column) -> Column:
    """Largest XY distance between two points of a path."""
    flat = F.array_distinct(F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    far = F.transform(flat, lambda p: F.array_max(F.transform(flat, lambda q: F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])))))
    return F.array_max(far)


def dashed(arrow: Column) -> Column:
    return F.regexp_replace(arrow, "(?<=.)(?=.)", "-")


def points(steps: DataFrame, paths: DataFrame) -> DataFrame:
    """path_id, seq (0 is the start), x, y, z by running sums."""
    run = Window.partitionBy("path_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    starts = paths.join(steps.select("path_id").distinct(), "path_id", "left_semi").select("path_id", F.lit(0).alias("seq"), F.col("sx").alias("dx"), F.col("sy").alias("dy"), F.col("sz").alias("dz"))
    rows = starts.unionByName(steps.join(paths.select("path_id"), "path_id", "left_semi").select("path_id", "seq", "dx", "dy", "dz"))
    return rows.select("path_id", "seq", *(F.sum(f"d{c}").over(run).alias(c) for c in "xyz"))


def horizontal_runs(points: DataFrame, steps: DataFrame) -> DataFrame:
    """Maximal runs of H steps: path_id, run_no, mean_z, mean_x, mean_y, node_count (one more than steps)."""
    by = Window.partitionBy("path_id").orderBy("seq")
    rows = points.join(coded(steps).select("path_id", "seq", "code"), ["path_id", "seq"], "left")
    flat = F.coalesce(F.col("code") == "H", F.lit(False))
    # A run's island: the number of other steps so far; its first node is the one before its first step.
    rows = rows.withColumn("island", F.sum(F.when(flat, 0).otherwise(1)).over(by)).withColumn("flat", flat)
    runs = rows.groupBy("path_id", "island").agg(F.avg("z").alias("mean_z"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), F.count("*").alias("node_count"), F.count_if("flat").alias("n")).where("n > 0")
    number = F.row_number().over(Window.partitionBy("path_id").orderBy("island"))
    return runs.select("path_id", number.alias("run_no"), *(F.round(c, 3).alias(c) for c in ("mean_z", "mean_x", "mean_y")), "node_count")


def collapsed(rows: DataFrame, key: str, order: list[str], code: str) -> DataFrame:
    """key, pattern: codes in order, equal neighbours once."""
    by = Window.partitionBy(key).orderBy(*order)
    changed = rows.withColumn("_before", F.lag(code).over(by)).where(F.col("_before").isNull() | (F.col("_before") != F.col(code)))
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(code).alias("_code"))))
    return changed.groupBy(key).agg(F.array_join(F.transform(ordered, lambda s: s["_code"]), "-").alias("pattern"))


def level_of(rows: DataFrame, levels: DataFrame, z: str, order: str, none: str = "UNKNOWN") -> DataFrame:
    """Adds level and z_min of the first level (by `order`) whose closed interval holds z.

    Levels are the storeys of a building: a table of more than 10,000 is refused.
    """
    most = 10_000
    found = levels.select(order, "level", "z_min", "z_max").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"level_of: more than {most} levels")
    level, floor = F.lit(none), F.lit(None).cast("double")
    for r in sorted(found, key=lambda r: r[order], reverse=True):
        inside = (F.col(z) >= r["z_min"]) & (F.col(z) <= r["z_max"])
        level, floor = F.when(inside, r["level"]).otherwise(level), F.when(inside, r["z_min"]).otherwise(floor)
    return rows.withColumns({"level": level, "z_min": floor})


def running_mean_clusters(values: Column, tolerance: float) -> Column:
    """Clusters of sorted structs (z, ...): a value joins while it is within tolerance of the running mean.

    array<array<struct>>; the order matters, so this is a fold and not a window.
    """
    empty = F.filter(F.array(values), lambda x: F.lit(False))
    state = F.struct(empty.alias("done"), F.filter(values, lambda x: F.lit(False)).alias("now"), F.lit(0.0).alias("sum"))

    def step(s, v):
        n = F.size(s["now"])
        near = (n > 0) & (F.abs(v["z"] - s["sum"] / n) <= tolerance)
        return F.when(near | (n == 0), F.struct(s["done"].alias("done"), F.concat(s["now"], F.array(v)).alias("now"), (s["sum"] + v["z"]).alias("sum"))).otherwise(
            F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), F.array(v).alias("now"), v["z"].cast("double").alias("sum"))
        )

    return F.aggregate(F.array_sort(values), state, step, lambda s: F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]))


def anchored_groups(values: Column, width: float) -> Column:
    """Group numbers (from 0) of sorted structs (v, ...): a new group starts beyond anchor + width."""
    state = F.struct(F.lit(-1).alias("group"), F.lit(None).cast("double").alias("anchor"), F.filter(F.transform(values, lambda x: F.struct(F.lit(0).alias("group"), x.alias("value"))), lambda x: F.lit(False)).alias("out"))

    def step(s, v):
        new = s["anchor"].isNull() | (F.abs(v["v"] - s["anchor"]) > width)
        group = F.when(new, s["group"] + 1).otherwise(s["group"])
        return F.struct(group.alias("group"), F.when(new, v["v"]).otherwise(s["anchor"]).alias("anchor"), F.concat(s["out"], F.array(F.struct(group.alias("group"), v.alias("value")))).alias("out"))

    return F.aggregate(F.array_sort(values), state, step, lambda s: s["out"])
