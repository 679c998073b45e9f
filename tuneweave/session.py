"""Spark session helpers: session construction and the shared checkpoint folder.

Lineage is cut only with reliable storage: a table written under the folder the
cluster names in ``spark.checkpoint.dir``. A local scratch folder is created
only when the session runs in local mode and nothing is configured (tests).
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app_name: str = "tuneweave",
              shuffle_partitions: int | None = None,
              driver_memory: str | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings this library expects."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_LOCAL_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if driver_memory:
        conf["spark.driver.memory"] = driver_memory
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for materialised intermediate tables.

    Order of preference: the context's checkpoint dir, then the
    ``spark.checkpoint.dir`` setting. Only a local-mode session with neither set
    gets a fresh scratch folder (as in tests); a cluster session must name one.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/DBFS) so materialised tables survive executor loss")
    scratch = tempfile.mkdtemp(prefix="tuneweave-ckpt-")
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir() or scratch


_WRITTEN: list[str] = []
_HOOKED = False


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet under the checkpoint root and read it back.

    This cuts lineage with one pass over the data (``checkpoint()`` would compute
    the plan twice unless cached) and leaves a table that any executor can read
    after a failure. Tables written by this process are removed when it exits
    (or earlier with :func:`release_materialized`).
    """
    global _HOOKED
    spark = df.sparkSession
    root = checkpoint_root(spark)
    path = os.path.join(root, "tables", f"{name}-{uuid.uuid4().hex}")
    df.write.mode("error").parquet(path)
    _WRITTEN.append(path)
    if not _HOOKED:
        atexit.register(_release_at_exit)
        _HOOKED = True
    return spark.read.parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the materialised-table folder for intermediate data
    written by other means (files, stream sinks); removed like the tables."""
    global _HOOKED
    path = os.path.join(checkpoint_root(spark), "tables", f"{name}-{uuid.uuid4().hex}")
    _WRITTEN.append(path)
    if not _HOOKED:
        atexit.register(_release_at_exit)
        _HOOKED = True
    return path


def release_materialized(spark: SparkSession) -> int:
    """Delete the tables this process materialised; call when the results
    that read them are no longer needed. Returns the number removed."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    while _WRITTEN:
        jpath = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        fs = jpath.getFileSystem(conf)
        if fs.exists(jpath):
            fs.delete(jpath, True)
            removed += 1
    return removed


def _release_at_exit() -> None:
    try:
        active = SparkSession.getActiveSession()
        if active is not None:
            release_materialized(active)
    except Exception:  # noqa: BLE001 - best effort at interpreter exit
        pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def materialized_root(spark: SparkSession) -> str:
    """Folder holding the tables written by :func:`materialize` (dense
    indexes); remove it after the job with the storage's own tools."""
    return os.path.join(checkpoint_root(spark), "tables")
