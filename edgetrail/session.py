"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Used only where the session names no shared checkpoint folder (tests on one machine).
LOCAL_SCRATCH = "/tmp/edgetrail-scratch"


def build_session(app: str = "edgetrail", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **RUNTIME_OPTIONS,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# HotSpot does not compile methods over 8000 bytes; wider stages run faster as split projections.
RUNTIME_OPTIONS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def tune(spark: SparkSession) -> SparkSession:
    """Set the SQL options the wide log projections need on a running session."""
    for key, value in RUNTIME_OPTIONS.items():
        spark.conf.set(key, value)
    return spark


SPREAD = "spark.edgetrail.spreadSmallInputs"


def spread(df: DataFrame) -> DataFrame:
    """Where SPREAD is set (benchmarks), give a small input as many partitions as there are cores.

    A file of one row group is one task.  The shuffle this adds is bounded by the rows of fewer
    splits than the cluster has cores.
    """
    if df.sparkSession.conf.get(SPREAD, "false") != "true":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """A narrow table dealt evenly over ``tasks`` partitions, by default as many as there are cores.

    However large its files are, a table of few row groups is read by as few tasks, and all that is derived from
    its rows would run in them.
    """
    return df.repartition(tasks or df.sparkSession.sparkContext.defaultParallelism)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a local one only where driver and executors are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not root and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (root or LOCAL_SCRATCH).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/edgetrail/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write a table that several outputs read and return the written table.

    Unlike a cached frame it survives lost executors and is read with column pruning.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)
