"""Cutting lineage, and folders, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all executors share. Only where Spark runs in one process (tests) may none be set; it is then a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="weftwork-")
    return f"{at.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is not to be broadcast. After an explode or a Python step the planner's estimate is that of the rows before it, so it would send any number of rows through the driver."""
    return df.hint("merge")


def cut(df: DataFrame) -> DataFrame:
    """Lineage cut by a checkpoint in the shared folder. Only where Spark runs in one process (tests) may none be set; it is then a temporary one."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(at or tempfile.mkdtemp(prefix="weftwork-"))
    return df.checkpoint()
