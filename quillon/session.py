"""Spark sessions and the folder that all of their executors share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: What every session of the engine needs; sizes of shuffles and scans are left to the cluster.
CONF = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.parquet.filterPushdown": "true", "spark.sql.sources.partitionOverwriteMode": "dynamic"}


def session(name: str = "quillon", **conf: str) -> SparkSession:
    """The active session, or one with CONF and the given settings."""
    build = SparkSession.builder.appName(name)
    for k, v in (CONF | conf).items():
        build = build.config(k, v)
    return build.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; one of our own only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "quillon-checkpoints")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows from the shared folder, without their lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
