"""Session settings and lineage cutting shared by the operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: int | str = 8, partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_root(master: str, named: str | None) -> str:
    """Folder for checkpoints and written tables: the one the cluster names.

    A folder of this machine will do for a local session only; anywhere else other executors could not reach it.
    """
    if named:
        return named.rstrip("/")
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share (master {master})")
    return tempfile.mkdtemp(prefix="tidemark-")


def _root(spark: SparkSession) -> str:
    """The shared folder of the session; a local session keeps the first one it made."""
    sc = spark.sparkContext
    root = shared_root(sc.master, spark.conf.get(CHECKPOINT_CONF, None) or sc.getCheckpointDir())
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative plan through reliable storage, whose files survive a lost executor."""
    _root(df.sparkSession)
    return df.checkpoint()


def scratch_folder(spark: SparkSession) -> str:
    """New folder next to the checkpoints, reachable from every executor."""
    return f"{_root(spark)}/tidemark-{uuid.uuid4().hex}"
