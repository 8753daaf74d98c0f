"""Structured Streaming: incremental bin states, daily rollups and sliding station statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meshlag.config import DEFAULT
from meshlag.functions.bins import distance_bin
from meshlag.sources.tables import PAIR_SCHEMA


def pair_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """New Parquet files of pair rows as they arrive."""
    return spark.readStream.schema(PAIR_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def bin_states(pairs: DataFrame) -> DataFrame:
    """Running sums of every (center, bin); each file counts once, also after a restart."""
    binned = pairs.where("dist_km > 0 AND coherence IS NOT NULL").withColumn("bin", distance_bin("dist_km")).where("bin IS NOT NULL")
    return binned.groupBy("center", "bin").agg(F.sum("coherence").alias("s1"), F.sum(F.col("coherence") * F.col("coherence")).alias("s2"), F.sum("dist_km").alias("sd"), F.count("*").alias("n"))


def accumulate_bins(pairs: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hands the complete state to `sink` after each batch, all available files first."""
    return bin_states(pairs).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()


def refit(states: DataFrame) -> DataFrame:
    """Decay fits of a state table."""
    from meshlag.functions.bins import finalise
    from meshlag.operators.fit import fit_decay

    return fit_decay(finalise(states, DEFAULT.min_bin_count), ["center"])


def daily_rollup(pairs: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Mean, deviation and count of each day and centre; a day closes once the watermark passes it."""
    return pairs.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day"), "center").agg(F.avg("coherence").alias("mean"), F.stddev_pop("coherence").alias("sd"), F.count("*").alias("n")).select(F.col("window.start").alias("day"), "center", "mean", "sd", "n")


def closed_days(pairs: DataFrame, lateness: str = "2 days", digits: int | None = None) -> DataFrame:
    """Mean, median, deviation and count of each day and centre, for append mode: a day comes once, when it is closed.

    The median is exact: the lower one where two values share the middle. The state of a day is sums and how often
    each value occurs, both merged from the tasks' partial ones. With `digits` values are counted as rounded to them,
    and the median is exact to them: coherences, from -1 to 1, then make 2 * 10**digits + 1 counts at most, however
    many rows a day has. Null values count as rows and enter nothing else.
    """
    value = F.col("coherence").cast("double")
    by = pairs.withColumn("_v", value if digits is None else F.round(value, digits)).withWatermark("ts", lateness).groupBy(F.window("ts", "1 day"), "center")
    rolled = by.agg(F.avg("coherence").alias("mean"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _v)").alias("median"), F.stddev_pop("coherence").alias("sd"), F.count("*").alias("n"))
    return rolled.select(F.col("window.start").alias("day"), "center", "mean", "median", "sd", "n")


def sliding_statistics(obs: DataFrame, lateness: str = "3 hours", length: str = "2 hours", step: str = "1 hour") -> DataFrame:
    """Station statistics over overlapping windows."""
    return obs.withWatermark("ts", lateness).groupBy(F.window("ts", length, step), "station").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), "station", "mean", "sd", "n")
