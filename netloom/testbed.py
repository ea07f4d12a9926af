"""The star-schema tables seen as routed networks: one path for each order, one step for each line item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Every column of lineitem but the key: rows that agree on all of them are interchangeable.
STEP_ORDER = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path_id, seq (from 1), dx, dy, dz."""
    q = F.when(F.col("l_returnflag") == "R", -100.0).otherwise(100.0) * F.col("l_quantity")
    axis = F.col("l_linenumber") % 3
    return (
        table(spark, sf_dir, "lineitem")
        # Rows equal up to l_returnflag make equal steps: the last two columns needn't be shuffled to tell them apart.
        .withColumn("seq", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*STEP_ORDER[:-2])))
        .select(
            F.col("l_orderkey").alias("path_id"),
            "seq",
            F.when(axis == 1, q).otherwise(0.0).alias("dx"),
            F.when(axis == 2, q).otherwise(0.0).alias("dy"),
            F.when(axis == 0, q).when(F.col("l_tax") >= 0.07, q / 2).otherwise(0.0).alias("dz"),
        )
    )


def starts(path: Column, equipment: Column) -> dict[str, Column]:
    """The start point of a path."""
    at = {"sx": equipment % 100 * 1000, "sy": path % 10 * 50, "sz": path % 3 * 5000}
    return {k: v.cast("double") for k, v in at.items()}


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path_id, equipment, utility, size and the start point."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("path_id"),
        F.col("o_custkey").alias("equipment"),
        F.col("o_orderpriority").alias("utility"),
        F.col("o_orderstatus").alias("size"),
        *(v.alias(k) for k, v in starts(F.col("o_orderkey"), F.col("o_custkey")).items()),
    )


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.col("r_regionkey") * 3000.0
    return table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("level"), low.alias("z_min"), (low + 3000.0).alias("z_max"))


def obstacles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obstacle_id, category and box."""
    key, half = F.col("p_partkey"), F.col("p_size") * 10.0
    x, y, z = (key % 100 * 1000).cast("double"), (F.floor(key / 100) % 100 * 1000).cast("double"), F.col("p_size") * 300.0
    kinds = F.array(*(F.lit(c) for c in ("COLUMN_STRUCTURE", "POST", "H_BEAM", "STRUCTURAL_BEAM", "GRATING", "LADDER")))
    boxes = [f(c, half).alias(n) for n, f, c in (("x0", lambda c, h: c - h, x), ("y0", lambda c, h: c - h, y), ("z0", lambda c, h: c - h, z), ("x1", lambda c, h: c + h, x), ("y1", lambda c, h: c + h, y), ("z1", lambda c, h: c + h, z))]
    return table(spark, sf_dir, "part").select(key.alias("obstacle_id"), F.element_at(kinds, (key % 6 + 1).cast("int")).alias("category"), *boxes)


#: SQL of the same views, as common table expressions.
STEP_SQL = f"""
qty AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN -100.0 ELSE 100.0 END::DOUBLE * l_quantity AS q FROM lineitem),
step AS MATERIALIZED (SELECT l_orderkey AS path_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(STEP_ORDER)}) AS seq,
  CASE WHEN l_linenumber % 3 = 1 THEN q ELSE 0 END AS dx, CASE WHEN l_linenumber % 3 = 2 THEN q ELSE 0 END AS dy,
  CASE WHEN l_linenumber % 3 = 0 THEN q WHEN l_tax >= 0.07 THEN q / 2 ELSE 0 END AS dz FROM qty),
coded AS MATERIALIZED (SELECT *, CASE WHEN len < 1e-9 THEN NULL WHEN degrees(asin(least(abs(dz) / len, 1))) > 85 THEN 'R'
  WHEN degrees(asin(least(abs(dz) / len, 1))) < 5 THEN 'H' ELSE 'D' END AS code
  FROM (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS len FROM step)),
path AS (SELECT o_orderkey AS path_id, o_custkey AS equipment, o_orderpriority AS utility, o_orderstatus AS size,
  CAST(o_custkey % 100 * 1000 AS DOUBLE) AS sx, CAST(o_orderkey % 10 * 50 AS DOUBLE) AS sy, CAST(o_orderkey % 3 * 5000 AS DOUBLE) AS sz FROM orders),
pt AS MATERIALIZED (SELECT s.path_id, s.seq, sx + sum(dx) OVER w AS x, sy + sum(dy) OVER w AS y, sz + sum(dz) OVER w AS z
  FROM step s JOIN path p ON s.path_id = p.path_id WINDOW w AS (PARTITION BY s.path_id ORDER BY seq)
  UNION ALL SELECT p.path_id, 0, sx, sy, sz FROM path p WHERE p.path_id IN (SELECT path_id FROM step))
"""
LEVEL_SQL = "lev AS (SELECT r_regionkey, r_name AS level, r_regionkey * 3000.0 AS z_min, r_regionkey * 3000.0 + 3000.0 AS z_max FROM region)"
OBSTACLE_SQL = """
ob0 AS (SELECT p_partkey AS obstacle_id, ['COLUMN_STRUCTURE','POST','H_BEAM','STRUCTURAL_BEAM','GRATING','LADDER'][p_partkey % 6 + 1] AS category,
  p_partkey % 100 * 1000.0::DOUBLE AS cx, (p_partkey // 100) % 100 * 1000.0::DOUBLE AS cy, p_size * 300.0::DOUBLE AS cz, p_size * 10.0::DOUBLE AS h FROM part),
ob AS (SELECT obstacle_id, category, cx - h AS x0, cy - h AS y0, cz - h AS z0, cx + h AS x1, cy + h AS y1, cz + h AS z1 FROM ob0)
"""
