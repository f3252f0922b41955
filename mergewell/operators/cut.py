"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset a local session makes one; on
    a cluster that is an error, since executors would not share it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="engine-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder, without their lineage."""
    folder(df.sparkSession)
    return df.checkpoint()


def collected(spark: SparkSession) -> None:
    """Has the driver collect its garbage. What plans of a long run leave behind else fills the heap
    to its limit first, and shuffle files and checkpoints that nothing refers to stay as long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
