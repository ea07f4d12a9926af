"""Design documents and their tables.

Each document is one JSON file; unreadable ones and those with a list at the root give no rows. Top-level
keys come in either case. Records without a guid are dropped, and of equal guids the last one counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.text import OBSTACLE_CATEGORIES, first_of, json_position, normalized

_POINT = "struct<x:double,y:double,z:double>"
_BOX = f"struct<min:{_POINT},max:{_POINT}>"
_NODE = f"array<struct<guid:string,id:string,name:string,type:string,position:string,pocPosition:string,nodePosition:string,level:string,bay:string,utility:string,material:string,size:string,connectionGuidList:array<string>,boundaryBox:{_BOX}>>"
_EDGE = "array<struct<guid:string,id:string,type:string,utility:string,size:string,material:string,position:string,connectionGuidList:array<string>>>"
_POC = "array<struct<guid:string,id:string,name:string,utility:string,utilityGroup:string,size:string,pocPosition:array<double>>>"
_EQUIPMENT = f"array<struct<guid:string,id:string,name:string,type:string,process:string,maker:string,position:array<double>,boundaryBox:{_BOX},pocList:{_POC}>>"
_OBSTACLE = f"array<struct<obstacleId:string,name:string,ddworksType:string,ostType:string,boundary:{_BOX}>>"
_SPACE = f"struct<SpaceInfo:array<struct<levelName:string,boundary:{_BOX}>>>"
_UPPER = f"struct<Nodes:{_NODE},Edges:{_EDGE},Equipment:{_EQUIPMENT},Obstacles:{_OBSTACLE},FileInfo:{_SPACE}>"
_LOWER = f"struct<nodes:{_NODE},edges:{_EDGE},equipment:{_EQUIPMENT}>"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """source_file, nodes, edges, equipment, obstacles, levels of every *.json below path."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path)
    raw = raw.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"), "value").where(F.col("value").rlike(r"^\s*\{"))
    both = raw.withColumns({"u": F.from_json("value", _UPPER), "l": F.from_json("value", _LOWER)}).where("u is not null")
    return both.select(
        "source_file", F.coalesce("u.Nodes", "l.nodes").alias("nodes"), F.coalesce("u.Edges", "l.edges").alias("edges"), F.coalesce("u.Equipment", "l.equipment").alias("equipment"), F.col("u.Obstacles").alias("obstacles"), F.col("u.FileInfo.SpaceInfo").alias("levels")
    )


def _point(p: Column) -> Column:
    at = lambda k: F.when(F.size(p) >= 3, p[k]).otherwise(0.0)
    return F.struct(at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


def _last(rows: DataFrame) -> DataFrame:
    """The last record of each (file, guid)."""
    keyed = rows.withColumn("guid", first_of(F.col("r.guid"), F.col("r.id"))).where("guid is not null")
    return keyed.groupBy("source_file", "guid").agg(F.max_by("r", "at").alias("r"))


def nodes(docs: DataFrame) -> DataFrame:
    r = _last(docs.select("source_file", F.posexplode("nodes").alias("at", "r")))
    return r.select("source_file", "guid", "r.id", "r.name", normalized(F.col("r.type")).alias("type"), json_position(F.col("r.position"), F.col("r.pocPosition"), F.col("r.nodePosition")).alias("pos"), "r.level", "r.bay", "r.utility", "r.size", F.col("r.connectionGuidList").alias("conn"))


def edges(docs: DataFrame) -> DataFrame:
    r = _last(docs.select("source_file", F.posexplode("edges").alias("at", "r")))
    return r.select("source_file", "guid", "r.id", normalized(F.col("r.type")).alias("type"), "r.utility", "r.size", "r.material", F.col("r.connectionGuidList").alias("conn"))


def connections(docs: DataFrame) -> DataFrame:
    """One row for each connection point of an equipment, in the document's order."""
    e = docs.select("source_file", F.posexplode("equipment").alias("equipment_no", "e"))
    p = e.select("source_file", "equipment_no", F.coalesce(first_of(F.col("e.guid"), F.col("e.id")), F.lit("UnknownID")).alias("equipment_id"), F.coalesce(first_of(F.col("e.name")), F.lit("Unknown")).alias("equipment_name"), "e.process", "e.maker", F.posexplode("e.pocList").alias("poc_no", "p"))
    return p.select("source_file", "equipment_no", "equipment_id", "equipment_name", "process", "maker", "poc_no", first_of(F.col("p.guid"), F.col("p.id")).alias("poc_guid"), "p.name", "p.utility", F.col("p.utilityGroup").alias("utility_group"), "p.size", _point(F.col("p.pocPosition")).alias("pos"))


def obstacles(docs: DataFrame) -> DataFrame:
    o = docs.select("source_file", F.explode("obstacles").alias("o"))
    kind = normalized(F.col("o.ddworksType"))
    box = [F.col(f"o.boundary.{m}.{c}").alias(f"{c}{k}") for k, m in ((0, "min"), (1, "max")) for c in "xyz"]
    return o.select("source_file", F.col("o.obstacleId").alias("obstacle_id"), F.when(kind.isin(*OBSTACLE_CATEGORIES), kind).otherwise("OTHER").alias("category"), *box)


def levels(docs: DataFrame) -> DataFrame:
    s = docs.select("source_file", F.posexplode("levels").alias("ordinal", "s"))
    return s.select("source_file", "ordinal", F.col("s.levelName").alias("level"), F.col("s.boundary.min.z").alias("z_min"), F.col("s.boundary.max.z").alias("z_max"))


def objects_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Object boxes from CSV with a header; numbers that don't parse are 0."""
    rows = spark.read.csv(path, header=True, encoding=encoding, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c)
    return rows.select("SourceFile", "Category", "ID", "Name", "Level", *map(number, ("MinX", "MinY", "MinZ", "MaxX", "MaxY", "MaxZ")))


#: Columns of the positional bundle CSV, in their order; those from the eleventh on are numbers.
BUNDLE_COLUMNS = ["source_file", "process", "equipment", "utility", "maker", "bay", "level", "kind", "axis", "pipes", "pipe_count", "spacing", "elevation", "bop"] + [f"{m}_{c}" for m in ("min", "max", "mid") for c in "xyz"]


def bundles_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Bundles by the position of their columns; rows of fewer columns are dropped, numbers that don't parse are 0."""
    text = spark.read.option("wholetext", False).csv(path, header=True, encoding=encoding, schema=", ".join(f"`{c}` string" for c in BUNDLE_COLUMNS) + ", _bad string", mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", enforceSchema=True)
    rows = text.where(F.col("_bad").isNull()).drop("_bad")
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c)
    maker = F.coalesce(F.nullif("maker", F.lit("")), F.lit("N/A")).alias("maker")
    return rows.select(*(maker if c == "maker" else F.col(c) for c in BUNDLE_COLUMNS[:10]), number("pipe_count").cast("int").alias("pipe_count"), *map(number, BUNDLE_COLUMNS[11:]))


def pipe_category(*texts: Column) -> Column:
    """BRANCH PIPE, LATERAL or DUCT by words in an object's id, type and name; null for others."""
    both = F.upper(F.concat_ws(" ", *(F.coalesce(t, F.lit("")) for t in texts)))
    return F.when(both.contains("BRANCH") & both.contains("PIPE"), "BRANCH PIPE").when(both.contains("LATERAL"), "LATERAL").when(both.contains("DUCT"), "DUCT")


def bim_equipment(docs: DataFrame) -> DataFrame:
    """Equipment with its box and whether it stands in the level CR; points as MULTIPOINT Z text."""
    e = docs.select("source_file", F.posexplode("equipment").alias("no", "e"))
    room = levels(docs).where(F.upper(F.trim("level")) == "CR").groupBy("source_file").agg(F.min_by(F.struct("z_min", "z_max"), "ordinal").alias("cr"))
    box = [F.coalesce(f"e.boundaryBox.{m}.{c}", F.lit(0.0)).alias(f"{m}_{c}") for m in ("min", "max") for c in "xyz"]
    place = lambda p: F.array_join(F.transform(F.slice(p["pocPosition"], 1, 3), lambda x: x.cast("string")), " ")
    points = F.transform(F.filter("e.pocList", lambda p: p["pocPosition"].isNotNull()), place)
    rows = e.select("source_file", "no", F.col("e.id").alias("eq_id"), "e.name", "e.type", "e.process", "e.maker", F.coalesce(F.size("e.pocList"), F.lit(0)).alias("poc_total_count"), F.to_json("e.pocList").alias("poc_list"), *box, F.when(F.size(points) > 0, F.concat(F.lit("MULTIPOINT Z("), F.array_join(points, ", "), F.lit(")"))).alias("poc_geom_wkt"))
    rows = rows.join(room, "source_file", "left")
    main = (F.col("max_z") >= F.col("cr.z_min")) & (F.col("min_z") <= F.col("cr.z_max"))
    return rows.withColumns({**{f"length_{c}": F.abs(F.col(f"max_{c}") - F.col(f"min_{c}")) for c in "xyz"}, "is_main": F.coalesce(main, F.lit(False))}).drop("cr")


def bim_spaces(docs: DataFrame) -> DataFrame:
    s = docs.select("source_file", F.explode("levels").alias("s"))
    box = [F.coalesce(f"s.boundary.{m}.{c}", F.lit(0.0)).alias(f"{m}_{c}") for m in ("min", "max") for c in "xyz"]
    return s.select("source_file", F.col("s.levelName").alias("level_name"), *box).withColumns({f"size_{c}": F.abs(F.col(f"max_{c}") - F.col(f"min_{c}")) for c in "xyz"})


def bim_pipes(docs: DataFrame) -> DataFrame:
    """Ducts, laterals and branch pipes among nodes and edges, by words in their id, type and name."""
    def of(name: str, label: str) -> DataFrame:
        r = docs.select("source_file", F.explode(name).alias("r"))
        named = F.col("r.name") if label == "node" else F.lit(None).cast("string")
        return r.select("source_file", F.col("r.id").alias("object_id"), named.alias("name"), "r.type", pipe_category(F.col("r.id"), F.col("r.type"), named).alias("category"), json_position(F.col("r.position")).alias("pos"))

    return of("nodes", "node").unionByName(of("edges", "edge")).where("category is not null")
