"""Cutting lineage between stages."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table that a join copies to every task, in bytes of its rows in memory; larger ones are shuffled.
COPIED_BYTES = 32 << 20


def copied(df: DataFrame, size: int) -> DataFrame:
    """df, of ``size`` bytes by the caller's count, marked to be copied to every task if it is small enough."""
    return F.broadcast(df) if size <= COPIED_BYTES else df


def _folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names; only a local session (one machine) has one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or "/tmp/checkpoints").rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_scratch: list[tuple[SparkSession, str]] = []


@atexit.register
def _clean() -> None:
    for spark, path in _scratch:
        try:
            delete(spark, path)
        except Exception:  # the JVM may have ended before Python
            return


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the session ends."""
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def cut(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint in the shared folder: a short plan for what follows."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(_folder(spark))
    return df.checkpoint()


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written to the shared folder and read back: as ``cut``, but computed once."""
    spark, schema = df.sparkSession, df.schema
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
