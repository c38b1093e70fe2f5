"""Cutting lineage on the cluster's shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; a temporary one only where the session names none and runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder, so that no lost executor causes it to be worked out again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
