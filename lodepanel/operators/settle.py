"""Cutting lineage, and folders for intermediate tables, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a local session without one gets a folder of its own.

    On a cluster a folder of one machine would lose what other machines wrote, so there the setting must be given.
    """
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        held = context._jsc.sc().getCheckpointDir()
        top = held.get() if held.isDefined() else None
    if not top:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        top = f"file://{tempfile.mkdtemp(prefix='lodepanel-')}"
        context.setCheckpointDir(top)
    return top.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """`df` written to the session's checkpoint folder, so that lost executors cost no recomputation."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = checkpoint_folder(df.sparkSession)
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(folder)
    return df.checkpoint()
