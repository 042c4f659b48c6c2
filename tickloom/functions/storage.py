"""Shared storage: the folder that spark.checkpoint.dir names, and rows that are stored once and read many times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share.  One of our own is set only where the session names none, as in tests on one machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder: plans that read them do not repeat the work, and lost executors cost none."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
