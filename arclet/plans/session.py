"""What sessions need beyond Spark's own settings."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def share_code(spark: SparkSession) -> None:
    """Lets Python workers import this package when it runs from a source folder."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{env.get('PYTHONPATH', '')}:{root}".strip(":")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as a shuffle has: for much work on rows of few bytes, which one task would read at once."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def file_system(spark: SparkSession, path: str):
    """Spark's file system for a path, and the path as it takes it: for files of any store, not only local ones."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name that driver and executors all see: below spark.checkpoint.dir, or, where that is unset and all is one machine,
    in its temporary folder."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        top = f"{tempfile.gettempdir()}/checkpoints"
    return f"{top.rstrip('/')}/arclet-{uuid.uuid4().hex}"
