"""A folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which goes with the session.

    A session without that setting gets a temporary folder if it runs in one process; on a cluster this is an error, as
    every machine would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="voxelspan-"))
        root = spark.sparkContext.getCheckpointDir()
    if "://" not in root:
        root = f"file://{root.removeprefix('file:')}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return path.toString() if "://" in path.toString() else f"file://{path.toString().removeprefix('file:')}"


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor takes nothing with it."""
    path = f"{shared_dir(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
