"""Folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be sent to every task.
SMALL_ROWS = 100_000


def if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df, to be broadcast if it is counted to have at most so many rows; otherwise Spark joins it as it likes."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def kept(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder: several later steps start from it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a local session without that setting (a test) gets a
    temporary one of the machine, any other is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="wavefield-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"
