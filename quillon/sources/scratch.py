"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that deletes a query's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder_of(spark: SparkSession, name: str = "stream") -> str:
    """A new folder in spark.checkpoint.dir; a temporary one only where a local session has none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix=f"quillon-{name}-")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: what several branches read is computed once, and lineage ends here.

    Its files are many times smaller than its rows in memory, so joins on it are merged: by the size of files Spark would broadcast
    tables that the driver can't hold. The shuffle files behind it go once it is written: they are many times its size.
    """
    spark = df.sparkSession
    path = folder_of(spark, name) + "/table"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path).hint("merge")
    out._quillon_folder = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Deletes tables of kept() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_quillon_folder", None)
        if path:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
