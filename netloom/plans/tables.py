"""Written intermediate tables: how loops and shared subplans cut their lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """A new folder for intermediate tables, in the folder that all executors share.

    Where the session names none, a cluster uses the warehouse, which is shared as well; a session whose driver
    is its only executor (as in tests) gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.split("[")[0] == "local":
        base = tempfile.mkdtemp(prefix="netloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    elif not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_netloom"
    return f"{base.rstrip('/')}/netloom-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Cut the lineage: write the table, then read it back with the schema it was written with."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that no later step reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
