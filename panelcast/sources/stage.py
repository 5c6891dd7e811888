"""Cutting lineage: a reduced table that several branches of one query read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's reliable checkpoint folder, set from ``spark.checkpoint.dir``.

    A session on one machine (a local master) may go without and gets a temporary folder. On a cluster that
    would be a folder that other machines do not see, so there the setting must be made.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="panelcast-"))
    return context.getCheckpointDir()


def fresh_folder(spark: SparkSession) -> str:
    """A new folder for written tables beside the checkpoints."""
    return f"{checkpoint_folder(spark)}/tables-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Write the table once to the session's reliable checkpoint folder and continue from there.

    Meant for calendar-sized results of a large scan that a query uses in several places: the scan then
    runs once, and a lost executor rereads the files instead of repeating it.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Write the table as compressed Parquet beside the checkpoints and continue from the files.

    For tables that may be as long as the input: columns and statistics stay readable one by one.
    """
    spark, path = df.sparkSession, fresh_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
