"""Session and shared-storage helpers.

Jobs read ``spark.checkpoint.dir`` from the running session: on a cluster it
names a shared folder that survives executor loss. A folder of our own is set
only where the setting is unset and the master is local (a laptop, a test); on
a cluster without it we refuse, since a machine-local folder would be lost.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

_LOCAL_ONLY = "/tmp/fedsearch-checkpoints"


def get_spark(master: str | None = None, app: str = "fedsearch",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every job here assumes."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the session; a local one only on a local master."""
    return ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir is unset on {master}: "
                               "name a folder that all executors share")
        root = _LOCAL_ONLY
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def _scratch_root(spark: SparkSession) -> str:
    return os.path.join(checkpoint_root(spark), "fedsearch", spark.sparkContext.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path in this application's part of the shared checkpoint folder."""
    return os.path.join(_scratch_root(spark), f"{name}-{uuid.uuid4().hex}")


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and host of the file system that the session resolves it to.

    Python code on executors opens files by this name: a path without a
    scheme would there be a folder of each machine.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def open_filesystem(uri: str):
    """``(file system, path)`` of a qualified ``uri`` for Python code on executors; a scheme that it can't reach is an error."""
    from urllib.parse import urlparse

    from pyarrow import fs
    if "://" not in uri and not uri.startswith("file:"):
        raise ValueError(f"{uri}: name the file system (session.qualified)")
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def clean_scratch(spark: SparkSession) -> None:
    """Delete what this application stored. Call it when none of its results is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def store(df, name: str):
    """``df`` written as Parquet to the shared folder and read back.

    Every later use reads the same rows, also after a lost executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
