"""Clusters of points and bundles of parallel pipes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions import geometry as G
from netloom.operators.components import components
from netloom.operators.paths import anchored_groups
from netloom.plans.tables import work_dir, written


def near_pairs(points: DataFrame, key: list[str], eps: float, exact: Column | None = None) -> DataFrame:
    """(a, b) of points (id, x, y) of equal key within eps, a < b: grid cells of eps, one side to 3 x 3."""
    at = points.withColumns({"cx": F.floor(F.col("x") / eps), "cy": F.floor(F.col("y") / eps)})
    around = at.withColumn("cx", F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1))).withColumn("cy", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1)))
    both = at.alias("l").join(around.alias("r"), [*key, "cx", "cy"]).where("l.id < r.id")
    dx, dy = F.col("l.x") - F.col("r.x"), F.col("l.y") - F.col("r.y")
    return both.where(F.sqrt(dx * dx + dy * dy) <= eps).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))


def clusters(points: DataFrame, key: list[str], eps: float) -> DataFrame:
    """points with cluster (the least id of its component; lone points are clusters of one)."""
    label = components(near_pairs(points, key, eps))
    return points.join(label.withColumnRenamed("vertex", "id"), "id", "left").withColumn("cluster", F.coalesce("component", "id")).drop("component")


def vertical_bundles(pipes: DataFrame, bucket: str, tolerance: float = 100.0, spacing: float = 300.0, gap: float = 1000.0) -> DataFrame:
    """Bundles of vertical pipes (id, bucket, x, y, low, high), once aligned on x and once on y.

    Pipes whose aligned coordinate lies within 2 * tolerance of their group's first one are linked if they
    stand at most `spacing` apart and overlap in height up to `gap`; links make bundles. A bundle whose pipes
    all belong to another one of higher rank (pipes descending, axis, least pipe) is dropped.
    """
    spark = pipes.sparkSession
    where = work_dir(spark)
    out = None
    for axis, along, across in (("X", "x", "y"), ("Y", "y", "x")):
        entry = F.struct(F.col(along).alias("v"), "id", F.col(across).alias("o"), "low", "high")
        rows = pipes.groupBy(bucket).agg(F.collect_list(entry).alias("v")).select(bucket, F.explode(anchored_groups(F.col("v"), 2 * tolerance)).alias("g"))
        rows = written(rows.select(bucket, F.col("g.group").alias("grp"), "g.value.*"), f"{where}/{axis}")
        l, r = rows.alias("l"), rows.alias("r")  # noqa: E741
        linked = l.join(r, [bucket, "grp"]).where("l.id < r.id").where(
            (F.abs(F.col("l.o") - F.col("r.o")) <= spacing)
            & (F.greatest("l.low", "r.low") - F.least("l.high", "r.high") <= gap)
            & (F.abs(F.col("l.v") - F.col("r.v")) <= 2 * tolerance)
        )
        label = components(linked.select(F.col("l.id").alias("a"), F.col("r.id").alias("b")))
        one = rows.join(label.withColumnRenamed("vertex", "id"), "id", "left").withColumns({"bundle": F.coalesce("component", "id"), "axis": F.lit(axis)})
        out = one if out is None else out.unionByName(one)
    stats = out.groupBy(bucket, "axis", "bundle").agg(
        F.countDistinct(F.bround(F.col("o") / 10)).alias("pipe_count"),
        F.when(F.count("*") > 1, (F.max("o") - F.min("o")) / (F.count("*") - 1)).otherwise(0.0).alias("spacing"),
        F.min("low").alias("elevation"),
        F.max(F.col("high") - F.col("low")).alias("length"),
        F.array_sort(F.collect_set("id")).alias("pipes"),
    )
    stats = written(stats, f"{where}/stats")
    mine, other = stats.alias("m"), stats.select(bucket, F.col("axis").alias("_axis"), F.col("bundle").alias("_bundle"), F.col("pipe_count").alias("_count"), F.col("pipes").alias("_pipes"), F.explode("pipes").alias("_first"))
    higher = (F.col("_count") > F.col("pipe_count")) | ((F.col("_count") == F.col("pipe_count")) & (F.struct("_axis", "_bundle") < F.struct("axis", "bundle")))
    inside = mine.withColumn("_first", F.element_at("pipes", 1)).join(other, [bucket, "_first"]).where(higher & (F.size(F.array_except("pipes", "_pipes")) == 0))
    return stats.join(inside.select(bucket, "axis", "bundle").distinct(), [bucket, "axis", "bundle"], "left_anti")


def canonical(pipes: DataFrame) -> DataFrame:
    """pipes (xa..zb) with their unit direction ux, uy, uz, turned so that its first component is positive."""
    d = {c: F.col(f"{c}b") - F.col(f"{c}a") for c in "xyz"}
    rows = pipes.withColumn("_u", G.unit3(*d.values()))
    x, y, z = (F.col(f"_u.{c}") for c in "xyz")
    back = (x < 0) | ((F.abs(x) < 1e-4) & (y < 0)) | ((F.abs(x) < 1e-4) & (F.abs(y) < 1e-4) & (z < 0))
    rows = rows.withColumn("_back", back)
    turned = {f"u{c}": F.when(F.col("_back"), -F.col(f"_u.{c}")).otherwise(F.col(f"_u.{c}")) for c in "xyz"}
    ends = {f"{c}{a}": F.when(F.col("_back"), F.col(f"{c}{b}")).otherwise(F.col(f"{c}{a}")) for c in "xyz" for a, b in (("a", "b"), ("b", "a"))}
    return rows.withColumns(turned | ends).drop("_u", "_back")


def direction_groups(values: Column, degrees: float = 3.0) -> Column:
    """Group numbers (from 0) of sorted structs (..., ux, uy, uz): a value joins the first group whose first
    member points within `degrees` of its own direction, else it begins a group."""
    least = math.cos(math.radians(degrees))
    anchor = lambda v: F.struct(v["ux"].alias("x"), v["uy"].alias("y"), v["uz"].alias("z"))
    none = F.filter(F.transform(values, anchor), lambda x: F.lit(False))
    out = F.filter(F.transform(values, lambda v: F.struct(F.lit(0).cast("long").alias("group"), v.alias("value"))), lambda x: F.lit(False))

    def step(s, v):
        fits = F.transform(s["anchors"], lambda a: a["x"] * v["ux"] + a["y"] * v["uy"] + a["z"] * v["uz"] >= least)
        at = F.array_position(fits, True)
        group = F.when(at > 0, at - 1).otherwise(F.size(s["anchors"]).cast("long"))
        return F.struct(F.when(at > 0, s["anchors"]).otherwise(F.concat(s["anchors"], F.array(anchor(v)))).alias("anchors"), F.concat(s["out"], F.array(F.struct(group.alias("group"), v.alias("value")))).alias("out"))

    return F.aggregate(F.array_sort(values), F.struct(none.alias("anchors"), out.alias("out")), step, lambda s: s["out"])


def horizontal_bundles(pipes: DataFrame, bucket: str, tolerance: float = 100.0, spacing: float = 300.0, gap: float = 1000.0, degrees: float = 3.0) -> DataFrame:
    """Bundles of horizontal pipes (id, bucket, xa..zb): of one height group and direction, linked where they lie
    at most `spacing` beside each other and overlap lengthwise up to `gap`. bundle is its least pipe."""
    where = work_dir(pipes.sparkSession)
    rows = canonical(pipes).withColumn("v", (F.col("za") + F.col("zb")) / 2)
    entry = F.struct("v", "id", "ux", "uy", "uz", *(f"{c}{e}" for e in "ab" for c in "xyz"))
    high = rows.groupBy(bucket).agg(F.collect_list(entry).alias("v")).select(bucket, F.explode(anchored_groups(F.col("v"), tolerance)).alias("g"))
    # Sorted by height and identifier, the first pipe of a direction leads its group.
    flat = high.groupBy(bucket, F.col("g.group").alias("zgroup")).agg(F.collect_list("g.value").alias("v")).select(bucket, "zgroup", F.explode(direction_groups(F.col("v"), degrees)).alias("g"))
    rows = flat.select(bucket, "zgroup", F.col("g.group").alias("dgroup"), "g.value.*")
    by = [bucket, "zgroup", "dgroup"]
    lead = rows.groupBy(*by).agg(F.min_by(F.struct("ux", "uy", "uz"), F.struct("v", "id")).alias("d")).where("d.ux * d.ux + d.uy * d.uy >= 1e-6")
    side = F.sqrt(F.col("d.ux") * F.col("d.ux") + F.col("d.uy") * F.col("d.uy"))
    along = lambda e: F.col(f"x{e}") * F.col("d.ux") + F.col(f"y{e}") * F.col("d.uy") + F.col(f"z{e}") * F.col("d.uz")
    offset = (-(F.col("xa") + F.col("xb")) * F.col("d.uy") + (F.col("ya") + F.col("yb")) * F.col("d.ux")) / 2 / side
    rows = rows.join(lead, by).select(*by, "id", F.col("v").alias("z"), offset.alias("o"), F.least(along("a"), along("b")).alias("low"), F.greatest(along("a"), along("b")).alias("high"), (F.abs("d.ux") > F.abs("d.uy")).alias("on_y"))
    rows = written(rows, f"{where}/pipes")
    l, r = rows.alias("l"), rows.alias("r")  # noqa: E741
    linked = l.join(r, by).where("l.id < r.id").where(
        (F.abs(F.col("l.o") - F.col("r.o")) <= spacing) & (F.greatest("l.low", "r.low") - F.least("l.high", "r.high") <= gap) & (F.abs(F.col("l.z") - F.col("r.z")) <= 2 * tolerance)
    )
    label = components(linked.select(F.col("l.id").alias("a"), F.col("r.id").alias("b")))
    found = rows.join(label.withColumnRenamed("vertex", "id"), "id", "left").withColumn("bundle", F.coalesce("component", "id"))
    return found.groupBy(bucket, "bundle", F.when(F.col("on_y"), "Y").otherwise("X").alias("axis")).agg(
        F.countDistinct(F.bround(F.col("o") / 10)).alias("pipe_count"),
        F.when(F.count("*") > 1, (F.max("o") - F.min("o")) / (F.count("*") - 1)).otherwise(0.0).alias("spacing"),
        F.min("z").alias("elevation"), F.max(F.col("high") - F.col("low")).alias("length"), F.array_sort(F.collect_set("id")).alias("pipes"),
    )
