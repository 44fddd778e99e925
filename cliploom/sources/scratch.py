"""Intermediate rows in the folder that the driver and all executors share.

The folder is the session's spark.checkpoint.dir.  Where that is unset, a local session takes a temporary folder; a session
on a cluster has no folder that all executors see, so it must name one.
"""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PATH = "_scratch_path"


def shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            given = tempfile.mkdtemp(prefix="scratch-")
        context.setCheckpointDir(given)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint, which Spark removes when its cleaner is set to and nothing refers to it any more."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows as a table of the shared folder, for steps of few rows: empty partitions make no files, and small files
    are read together, so what follows has tasks by the bytes and not by the partitions.  `dropped` removes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _PATH, path)
    return out


def is_written(df: DataFrame) -> bool:
    """Whether `written` made the frame."""
    return getattr(df, _PATH, None) is not None


def dropped(*frames: DataFrame | None) -> None:
    """Removes what `written` wrote for the frames; nothing may read them any more."""
    for df in frames:
        if (path := getattr(df, _PATH, None)) is not None:
            there = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(there, True)


def shares(rows: int, most: int) -> int:
    """In how many partitions of at most `most` rows, about, so many rows fit."""
    return max(1, math.ceil(rows / most))
