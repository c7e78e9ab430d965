"""Spark session helpers.

The library never owns the session on a cluster: it reads what the cluster
configured (``spark.checkpoint.dir`` above all) and only fills gaps, as in tests.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this library relies on.  They are applied only when the
# caller builds the session through ``get_spark``; an existing cluster session
# keeps its own values.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "sieve", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session.  ``master`` defaults to ``local[*]``."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    elif not os.environ.get("SPARK_MASTER"):
        b = b.master("local[*]")
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS/S3/...)
    and is used as is; a cluster session without one is an error.  Only a local
    session without one (tests, local runs) gets a fresh folder of its own.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            # a machine-local folder would not survive a lost executor on a cluster
            raise RuntimeError("spark.checkpoint.dir is not set: name a shared folder (HDFS, S3, ...)")
        d = tempfile.mkdtemp(prefix="sieve-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never local).

    Later steps read the checkpoint, so the shuffle files behind it go as soon as it is
    written instead of when the driver happens to collect its garbage."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        # the setting counts for frames made under it
        return df.select("*").checkpoint(eager=True)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


_MEMO: dict = {}


def reuse(spark: SparkSession, key: tuple, build) -> DataFrame:
    """Build a derived table once per application and keep it persisted
    (memory, spilling to disk).  Lineage is kept, so a lost executor's blocks are
    recomputed; many queries over the same derived table then share one
    computation instead of re-planning it inside every branch."""
    from pyspark import StorageLevel
    k = (spark.sparkContext.applicationId,) + tuple(key)
    if k not in _MEMO:
        _MEMO[k] = build().persist(StorageLevel.MEMORY_AND_DISK)
    return _MEMO[k]
