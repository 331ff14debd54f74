"""Tables that one job writes and later stages read again.

Everything that must outlive an executor goes to the folder named by
``spark.checkpoint.dir``, which all executors and the driver share.  Where that setting
is absent, a local session, as in tests, has a folder of its own; any other session is refused.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of this session, as a path that Spark can write to."""
    folder = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_KEY} to a folder that the driver and all executors share")
        folder = getattr(spark, "_wayline_folder", None)
        if folder is None:
            folder = "file://" + tempfile.mkdtemp(prefix="wayline-")
            spark._wayline_folder = folder
    return folder.rstrip("/")


def new_table_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    spark._wayline_tables = [*getattr(spark, "_wayline_tables", []), path]
    return path


def drop_tables(spark: SparkSession) -> int:
    """Delete the tables that this session's operators wrote; results that still read them break.  Returns their number."""
    paths, spark._wayline_tables = getattr(spark, "_wayline_tables", []), []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def materialize(df: DataFrame, name: str = "step", options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; cuts the lineage durably."""
    spark = df.sparkSession
    path = new_table_path(spark, name)
    df.write.options(compression="zstd", **(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps whose tables are written: Spark deletes them once their plans are collected, and the driver may not do that for long."""
    spark._jvm.System.gc()


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
