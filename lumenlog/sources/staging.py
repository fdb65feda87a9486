"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only where the master is local and the setting is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "/tmp/checkpoints"
    return f"{root.rstrip('/')}/lumenlog"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses; what is written there goes when the driver exits."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends here, and what is read twice is the same twice."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete this driver's staged tables, once their readers are done; called at exit."""
    while _MADE:
        spark, path = _MADE.pop()
        with contextlib.suppress(Exception):  # the JVM may be gone at exit
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


atexit.register(release)
