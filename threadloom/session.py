"""Spark session for local work; on a cluster the session that is there is used."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and benches; settings that depend on the data stay with AQE."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("threadloom")
        .config("spark.sql.shuffle.partitions", os.environ.get("THREADLOOM_SHUFFLE", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables that are read again: the one of the cluster's spark.checkpoint.dir.

    Where none is set a local session takes one of this machine's; on a cluster that would be lost with an executor or
    not be found by others, so there it is an error.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="threadloom-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder: later readers survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
