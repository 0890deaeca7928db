"""Written tables: what cuts lineage in a way that outlives executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, one of our own in local mode, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = spark.conf.get("spark.stancelake.ownDir", None)
        if not base:
            base = tempfile.mkdtemp(prefix="stancelake-")
            spark.conf.set("spark.stancelake.ownDir", base)
    return base.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone at exit; the folder is the cluster's to clear
        return


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/stancelake/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(remove, spark, path)
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
