"""Lineage cuts in the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Where none is named, a temporary one serves a local master only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


#: Rows of a table that is sent whole to every executor at most, a few hundred bytes each.
SMALL_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """`df` marked for broadcast when it is counted to hold at most SMALL_ROWS rows; beyond, Spark shuffles the join."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def move(spark: SparkSession, path: str, to: str) -> bool:
    """Renames a folder of the shared file system, whose new parent is made; false where there is none."""
    at, target = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x) for x in (path, to))
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(target.getParent())
    return files.exists(at) and files.rename(at, target)


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder: lost executors cost a reread, and lineage ends here."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
