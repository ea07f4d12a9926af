"""Sinks: partitioned JSON, CSV, idempotent imports and schema checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from netloom.functions.text import file_safe


def write_routes(routes: DataFrame, path: str, file: str = "source_file", equipment: str = "equipment_name") -> None:
    """One folder of JSON for each (file, equipment), under file-safe names."""
    routes.withColumns({"_file": file_safe(F.col(file)), "_equipment": file_safe(F.col(equipment))}).write.partitionBy("_file", "_equipment").mode("overwrite").json(path)


def write_groups_csv(groups: DataFrame, path: str) -> None:
    """CSV of scalar columns, nulls as -, arrays joined by |."""
    shown = [F.array_join(c, "|").alias(c) if t.startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c, t in groups.dtypes if not t.startswith("struct")]
    groups.select(*shown).write.csv(path, header=True, mode="overwrite")


def replaced_files(existing: DataFrame, batch: DataFrame, file: str) -> DataFrame:
    """The existing rows of files that the batch doesn't hold, and the batch: importing twice changes nothing."""
    return existing.join(batch.select(file).distinct(), file, "left_anti").unionByName(batch)


def without_route(vectors: DataFrame, guid: str) -> DataFrame:
    return vectors.where(~F.col("route_path_guid").eqNullSafe(F.lit(guid)))


def drifted(found: StructType, wanted: StructType, exact: bool = False, types: bool = False) -> bool:
    """Whether a stored schema no longer fits: a wanted column is missing (or, exact, any name differs);
    with `types` also where a type differs."""
    a, b = {f.name: f.dataType for f in found}, {f.name: f.dataType for f in wanted}
    if exact and set(a) != set(b):
        return True
    return any(n not in a or (types and a[n] != t) for n, t in b.items())


def store_vectors(vectors: DataFrame, path: str) -> None:
    """Appends vectors, partitioned by process so that searches with this filter prune their files."""
    vectors.write.partitionBy("process_name").mode("append").parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    """JSON lines of any table: branch reports, designed routes, vectors with their parts, evaluations, parameters."""
    rows.write.mode("overwrite").json(path)


def appended(rows: DataFrame, path: str, clean: bool = False) -> None:
    """Appends an import without asking what is there; `clean` starts anew."""
    rows.write.mode("overwrite" if clean else "append").parquet(path)


def vector_text(vec) -> Column:
    """A vector as [a,b,...], the literal of vector stores."""
    return F.concat(F.lit("["), F.array_join(F.transform(vec, lambda x: x.cast("string")), ","), F.lit("]"))


def vector_of_text(text) -> Column:
    return F.from_json(text, "array<double>")
