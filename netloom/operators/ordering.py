"""Global row numbers without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.plans.tables import work_dir, written


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the position (from 1) in the given order.

    The rows are range-partitioned and sorted; each partition numbers its own rows, and the partitions'
    sizes (one small row each) give the offsets. Rows are written once, so that both passes see the same.
    """
    marked = rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    marked = written(marked, f"{work_dir(rows.sparkSession)}/numbered")
    part = F.shiftright("_at", 33)
    sizes = {r[0]: r[1] for r in marked.groupBy(part.alias("p")).count().collect()}
    offsets, total = [], 0
    for p in sorted(sizes):
        offsets.append((p, total))
        total += sizes[p]
    if not offsets:
        return marked.withColumn(name, F.lit(0).cast("long")).drop("_at")
    table = F.create_map(*(F.lit(x) for pair in offsets for x in pair))
    own = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.withColumn(name, (F.element_at(table, part) + own + 1).cast("long")).drop("_at")
