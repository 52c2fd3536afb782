"""Cutting lineage with tables in the shared scratch folder.

A cluster names that folder in ``spark.checkpoint.dir``; only where it is unset
(tests, a laptop) a temporary one is made.  Tables are plain Parquet, so an
executor that is lost takes nothing with it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; a local one only where driver and executors share a machine."""
    base = spark.conf.get(_SETTING, None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"{_SETTING} names no shared folder")
        base = f"file://{tempfile.mkdtemp(prefix='emberline-')}"
        spark.conf.set(_SETTING, base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the scratch folder."""
    return f"{scratch_dir(spark)}/emberline/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to a new table in the scratch folder and return a DataFrame that reads it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path  # noqa: SLF001  for discard()
    return table


def discard(df: DataFrame) -> None:
    """Delete a table made by materialize() that nothing reads any more."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
