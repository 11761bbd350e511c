"""What the operators need of a session: importable workers and a shared folder for intermediate tables."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..sources import checkpoints

ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package and set the checkpoint folder where none is set.

    On a cluster the package is installed or sent by --py-files and spark.checkpoint.dir names a folder that all
    machines share; only sessions without that setting, as in tests, get a local folder.
    """
    context = spark.sparkContext
    paths = context.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        context.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    checkpoints.shared_folder(spark)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder: lost executors don't make Spark compute it again."""
    prepare(df.sparkSession)
    return checkpoints.cut(df)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again; checkpoints.discard() deletes it."""
    prepare(df.sparkSession)
    return checkpoints.stored(df)
