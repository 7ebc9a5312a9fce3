"""Cutting lineage in loops, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one in local mode, whose executors are this process; elsewhere an
    error, as executors can't see each other's disks."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is unset: it must name a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="feedloom-")


def cut(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the folder of spark.checkpoint.dir, which is set here only if the session has none."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_base(spark))
    return df.checkpoint()
