"""Schemas of the tables that imports fill, and how an empty or stale table is made anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from netloom.sources.sinks import drifted

_BOX = ", ".join(f"{m}_{c} double" for m in ("min", "max") for c in "xyz")
_SIZE = ", ".join(f"length_{c} double" for c in "xyz")
_OWNER = "source_file string, main_eq_name string, process string, maker string"

#: Columns of the stored tables.
TABLES = {
    "bim_equipment": f"source_file string, eq_id string, name string, type string, process string, maker string, poc_total_count int, utility_poc_info string, poc_list string, {_BOX}, {_SIZE}, poc_geom_wkt string, is_main boolean",
    "bim_obstacle": f"{_OWNER}, object_id string, name string, ddworks_type string, ost_type string, {_BOX}, {_SIZE}, pos_x double, pos_y double, pos_z double",
    "bim_space": f"{_OWNER}, level_name string, {_BOX}, size_x double, size_y double, size_z double, {_SIZE}",
    "duct_lateral": f"source_file string, main_eq_name string, process string, object_id string, name string, type string, category string, level string, utility string, material string, size string, {_BOX}, {_SIZE}, pos_x double, pos_y double, pos_z double",
    "objects": f"source_file string, category string, id string, name string, level string, {_BOX}",
    "route_vectors": "id long, route_path_guid string, process_name string, equipment_name string, utility_group string, utility string, size string, path_arrow string, total_length double, bend_count int, vec array<double>",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def ensured(spark: SparkSession, name: str, path: str, exact: bool = False, types: bool = False) -> DataFrame:
    """The stored table, or an empty one of its schema where there is none or the stored schema no longer fits."""
    wanted = schema(name)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        found = spark.read.parquet(path)
        if not drifted(found.schema, wanted, exact, types):
            return found
    spark.createDataFrame([], wanted).write.mode("overwrite").parquet(path)
    return spark.read.schema(wanted).parquet(path)
