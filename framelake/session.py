"""Paths that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; where that is unset, a new local folder if all runs in one
    process, as in tests. Raises RuntimeError on a cluster, whose machines share no local folder."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="framelake-")
        sc.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the JVM ends."""
    path = f"{shared_dir(spark)}/clip-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at.getParent())
    fs.deleteOnExit(at)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder and read back, so that what uses it several times works it out once, whatever executors are lost."""
    path = shared_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
