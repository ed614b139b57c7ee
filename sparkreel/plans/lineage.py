"""Shared storage for intermediate results."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as set by ``spark.checkpoint.dir``.

    A local session without that setting gets a new temporary folder; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(rows: DataFrame) -> DataFrame:
    """Rows written to the shared folder, so that a lost executor does not replay their history."""
    spark = rows.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return rows.checkpoint()


def free_shuffles(spark: SparkSession) -> None:
    """Asks for the shuffle files of finished steps to be removed.

    They go once their plans are collected as garbage on the driver, which it may not need to do for
    hours. A plan that has just ended is still held for a moment, so that is asked for twice.
    """
    for pause in (0.5, 0):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(pause)


def computed_once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Rows with one more column that is computed once per row, however often it is mentioned later.

    Spark merges projections and moves filters below them, with a copy of the expression in each
    place; a generator stays where it is.
    """
    return rows.select("*", F.explode(F.array(value)).alias(name))
