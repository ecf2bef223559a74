"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, name: str = "evenhand") -> SparkSession:
    """A single-JVM session for tests and the bench; on a cluster pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.files.maxPartitionBytes", "16m")
        .getOrCreate()
    )


def shipped(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for the functions that run in their workers."""
    context = spark.sparkContext
    if getattr(context, "_evenhand_shipped", None) != context.applicationId:
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = os.path.join(tempfile.mkdtemp(prefix="evenhand-code-"), "evenhand")
        context.addPyFile(shutil.make_archive(archive, "zip", top, "evenhand"))
        context._evenhand_shipped = context.applicationId


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's ``spark.checkpoint.dir``, or the checkpoint folder
    that was set on the context.

    Only where that setting is absent (local tests) a temporary folder is set instead.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        folder = configured
    else:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="evenhand-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute a short intermediate table once and keep it in the shared folder.

    Several later steps read it, and without this each of them would go back to the data. The
    checkpoint survives the loss of executors.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()
