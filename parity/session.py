"""Session defaults, shared scratch space and reliable checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings every job of this library assumes. They are defaults: a cluster may override any of them.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "parity", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library defaults; extra settings are passed with ``__`` in place of dots."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Put the result-relevant settings (time zone, ANSI) on a session somebody else built."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.ansi.enabled", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local master, where the
    driver's disk is every executor's disk, falls back to a new temporary folder.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="parity-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, never used before."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def pinned(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint.

    Needed where a plan reads rows whose placement came from sampled range bounds more than once:
    recomputing them after a lost executor could place them differently.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
