"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes handed to a Python worker at a time: few rows, and fewer where texts are long.
BATCH_ROWS, BATCH_BYTES = 256, 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory of a Python worker whatever the text length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the session names. Where none is set, a temporary one serves a local master only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder: lost executors cost a reread, and lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def cut_freed(df: DataFrame) -> DataFrame:
    """`cut`, with the shuffle files of the job removed as soon as its result is written."""
    key, spark = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", df.sparkSession
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        return cut(df.select("*"))  # the setting counts for plans that are made from now on
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Writes df to `path` in the shared folder and reads it again: lineage ends here, and so does the planner's guess of the size."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(column: str | Column = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fold(column: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5: 0 is held out."""
    col = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(col.cast("string")), F.lit(0)) % 5


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most `rows` labelled documents (text, y) outside the held-out fold.

    The ids are picked by hash order, so the pick neither follows the storage order nor a source. The id
    list is bounded by `rows` and therefore broadcast; the documents are scanned once, and only the picked
    ones are shuffled. Of documents that share an id, the first text in order stands for all.
    """
    picked = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id") != 0))
        .groupBy("doc_id")
        .agg(F.max(label).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    found = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y")
