"""Stored results read back: routing results, groups, normalisation parameters, database tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.text import first_of, legacy_lengths, legacy_vectors
from netloom.operators.vectors import FALLBACK

_XYZ = "struct<x:double,y:double,z:double>"
_PATH = f"struct<path_summary:string,terminal_label:string,end_node_id:string,end_node_type:string,node_positions:array<array<double>>,path_arrow:string,path_range:{_XYZ},path_step_vector:string,path_step_length:string,path_step_vectors:string,path_step_lengths:string>"
_ROUTING = f"struct<equipment_name:string,equipment_id:string,equipment_process:string,equipment_maker:string,poc_paths:array<struct<start_poc_id:string,start_poc_info:struct<utility:string,size:string,position:array<double>,pocPosition:array<double>>,paths:array<{_PATH}>>>>"


def _documents(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    return raw.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"), "value")


def routing_results(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """One row for each stored path, its missing features computed from its positions; unreadable files give none.

    Vectors and lengths may be stored as arrays or as the old texts, (x, y, z) | ... and a, b, ...
    """
    doc = _documents(spark, path, pattern).select("source_file", F.from_json("value", _ROUTING).alias("d")).where("d.poc_paths is not null")
    point = doc.select("source_file", "d.*").withColumn("p", F.explode("poc_paths")).drop("poc_paths")
    rows = point.select("*", F.posexplode("p.paths").alias("path_no", "r"))
    at = F.col("r.node_positions")
    steps = F.zip_with(F.slice(at, F.lit(2), F.size(at)), F.slice(at, F.lit(1), F.size(at) - 1), lambda b, a: F.struct(*((b[k] - a[k]).alias(c) for k, c in enumerate("xyz"))))
    stored = _vectors(F.coalesce("r.path_step_vectors", "r.path_step_vector"))
    length = lambda v: F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"])
    lengths = _numbers(F.coalesce("r.path_step_lengths", "r.path_step_length"))
    axis = lambda k: F.transform(at, lambda p: p[k])
    box = F.struct(*(F.coalesce(F.array_max(axis(k)) - F.array_min(axis(k)), F.lit(0.0)).alias(c) for k, c in enumerate("xyz")))
    dash = lambda c: first_of(c, F.lit("-"))
    out = rows.select(
        "source_file", *(F.coalesce(c, F.lit("-")).alias(c) for c in ("equipment_name", "equipment_id", "equipment_process", "equipment_maker")), F.col("p.start_poc_id").alias("poc_id"), "path_no",
        dash(F.col("p.start_poc_info.utility")).alias("utility"), dash(F.col("p.start_poc_info.size")).alias("size"), F.coalesce("p.start_poc_info.position", "p.start_poc_info.pocPosition").alias("start_pos"),
        "r.path_summary", "r.terminal_label", "r.end_node_id", "r.end_node_type", "r.node_positions", "r.path_arrow", F.coalesce("r.path_range", box).alias("path_range"),
        F.coalesce(stored, steps).alias("step_vectors"), lengths.alias("_lengths"),
    )
    out = out.withColumn("step_lengths", F.coalesce("_lengths", F.transform("step_vectors", length))).drop("_lengths")
    tangent = lambda v: F.degrees(F.asin(F.least(F.abs(v["z"]) / length(v), F.lit(1.0))))
    code = lambda v: F.when(length(v) < 1e-9, F.lit(None)).when(tangent(v) > 85, "R").when(tangent(v) < 5, "H").otherwise("D")
    arrow = F.array_join(F.transform("step_vectors", code), "-")
    return out.withColumns({"path_arrow": first_of("path_arrow", arrow), "path_total_length": F.round(F.aggregate("step_lengths", F.lit(0.0), lambda t, x: t + x), 1)})


def _vectors(text: Column) -> Column:
    """Vectors of a JSON array of objects or of triples, else of the old text; null where there is no text."""
    objects, triples = F.from_json(text, f"array<{_XYZ}>"), F.from_json(text, "array<array<double>>")
    named = F.transform(triples, lambda v: F.struct(v[0].alias("x"), v[1].alias("y"), v[2].alias("z")))
    return F.when(text.startswith("[{"), objects).when(text.startswith("["), named).otherwise(legacy_vectors(text))


def _numbers(text: Column) -> Column:
    return F.when(text.startswith("["), F.from_json(text, "array<double>")).otherwise(legacy_lengths(text))


def stored_groups(spark: SparkSession, path: str) -> DataFrame:
    """Groups as stored: one JSON array of groups (or one group a line), their paths as an array."""
    return spark.read.option("multiLine", True).json(path)


def group_paths(groups: DataFrame) -> DataFrame:
    """One row for each path of stored groups; a path's own columns take the place of its group's."""
    own = groups.select(F.posexplode("paths").alias("path_no", "_p"), *(c for c in groups.columns if c != "paths"))
    inner = own.schema["_p"].dataType.names
    meta = [c for c in ("group_id", "equipment_name", "equipment_process", "equipment_id", "utility", "size") if c in groups.columns and c not in inner]
    return own.select("path_no", *meta, "_p.*")


def norm_params(spark: SparkSession, path: str) -> DataFrame:
    """One row of normalisation parameters; those that the file lacks have their fallback."""
    found = spark.read.option("multiLine", True).json(path)
    return found.select(*((F.coalesce(F.col(k).cast("double"), F.lit(v)) if k in found.columns else F.lit(v)).alias(k) for k, v in FALLBACK.items()))


def optional_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON table, empty where there is no such file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def uses_map(segments: DataFrame, segment_map: DataFrame | None) -> bool:
    """Whether the map table leads from paths to segments at all."""
    return segment_map is not None and not segment_map.join(segments, "segment_guid", "left_semi").isEmpty()


def path_details(details: DataFrame, segments: DataFrame, segment_map: DataFrame | None = None, route_path: str | None = None) -> DataFrame:
    """Details of paths (or of one path), numbered by segment and their own order.

    By the map table where it is usable, else by the path that a segment names. details: (segment_guid,
    detail_order, ...), segments: (segment_guid, route_path_guid, segment_order), segment_map: (route_path_guid,
    segment_guid, segment_order). The path's filter reaches the scan of the table that names it.
    """
    if uses_map(segments, segment_map):
        named = segment_map.select("route_path_guid", "segment_guid", "segment_order").join(segments.select("segment_guid"), "segment_guid")
    else:
        named = segments.select("route_path_guid", "segment_guid", "segment_order")
    if route_path is not None:
        named = named.where(F.col("route_path_guid") == route_path)
    from pyspark.sql import Window

    by = Window.partitionBy("route_path_guid").orderBy("segment_order", "detail_order")
    return details.join(named, "segment_guid").withColumn("seq", F.row_number().over(by))
