"""Tables written to the shared folder to cut lineage: later jobs read them back when executors are lost."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; a folder of this machine only where that is unset and all runs here."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="larkfold-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def placed(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for a table; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The table, written once and read back; with ``by``, in a folder for each value, so that who wants one reads no other."""
    path, schema = placed(df.sparkSession, name), df.schema
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
