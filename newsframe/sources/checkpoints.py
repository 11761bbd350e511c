"""Intermediate tables in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; local sessions without one, as in tests, get a local folder. On a cluster spark.checkpoint.dir has to name a shared one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="newsframe-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder, so that nothing before it is computed again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, *partitions: str) -> DataFrame:
    """df written as Parquet to that folder and read again: a plan of its own with the sizes of the files. checkpoint() keeps a plan's estimates, which loops multiply."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.partitionBy(*partitions).parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read.stored_at = path
    return read


def discard(df: DataFrame) -> None:
    """Delete the files of a table that stored() gave, once everything made from it is written. Of other frames nothing is deleted."""
    path = getattr(df, "stored_at", None)
    if path is not None:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
