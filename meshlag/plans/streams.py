"""Structured Streaming over the tables: ST1-ST3. Each query runs the stream to its end and returns what it wrote."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlag.functions.cut import cut, move, remove, shared_folder
from meshlag.plans.fixtures import PHASE, pair_day
from meshlag.plans.pairs import STATES
from meshlag.plans.registry import query, r, select
from meshlag.streaming import rollups


#: Files that all arrivals hold together at least: the tasks that write and read them.
FILES = 64


def _stage(rows: DataFrame, path: str, ts: str, arrivals: int) -> list[str]:
    """Writes `rows` in folders, one for each arrival, in the order of `ts`; many tasks write an arrival."""
    n = arrivals * math.ceil(max(FILES, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))) / arrivals)
    placed = rows.repartitionByRange(n, ts).withColumn("arrival_", F.floor(F.spark_partition_id() * arrivals / n).cast("int"))
    placed.write.partitionBy("arrival_").parquet(path)
    return [f"{path}/arrival_={k}" for k in range(arrivals)]


def _drain(rows: DataFrame, ts: str, roll: Callable[[DataFrame], DataFrame], keys: list[str] | None = None, closed: bool = False, arrivals: int = 4) -> DataFrame:
    """Streams `rows` through `roll` to the end: the last complete state or, with `keys`, the last row written for each key.

    With `closed` a row is written once, when the watermark has passed it.

    The rows arrive in the order of `ts`, as a station network delivers them: the files of an arrival come into the
    stream's folder together, and the stream goes on from its checkpoint until it has read them, before the next
    ones come. So the order of the batches hangs on no file's time. With keys only changed rows are written, and
    state that the watermark has passed is dropped. The result is stored, and the stream's input, state and output go.
    """
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{folder}/out"

    def keep(batch: DataFrame, n: int) -> None:
        written = (batch if closed else batch.withColumn("batch_", F.lit(n))).write
        if closed:  # a batch that is run again replaces what it wrote
            written.mode("overwrite").parquet(f"{out}/batch_={n}")
        else:
            written.mode("append" if keys else "overwrite").parquet(out)

    for k, staged in enumerate(_stage(rows, f"{folder}/staged", ts, arrivals)):
        if not move(spark, staged, f"{folder}/in/{k}") and k:  # few times make few arrivals
            continue
        stream = roll(spark.readStream.schema(rows.schema).parquet(f"{folder}/in/*"))
        stream.writeStream.outputMode("append" if closed else "update" if keys else "complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    written = spark.read.parquet(out)
    if not keys:
        last = cut(written.select(*stream.columns))
    else:
        rest = [c for c in stream.columns if c not in keys]
        last = cut(written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_").alias("s")).select(*keys, "s.*"))
    remove(spark, folder)
    return last


def _pairs(spark: SparkSession, sf_dir: str, places: bool) -> DataFrame:
    """Pair rows as a stream delivers them."""
    p = pair_day(spark, sf_dir, places)
    return p.select("center", F.col("date").cast("timestamp").alias("ts"), F.col("i").cast("string"), F.col("j").cast("string"), "dist_km" if places else F.lit(1.0).alias("dist_km"), "coherence")


@query(f"SELECT center, bin, n, {r('s1', 5)} AS s1, {r('sd', 2)} AS sd FROM {STATES} s")
def stream_bin_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bin sums accumulated over pair files that arrive one after another."""
    states = _drain(_pairs(spark, sf_dir, True), "ts", rollups.bin_states, arrivals=2)
    return select(states, {"center": "center", "bin": "bin", "n": "n", "s1": r("s1", 5), "sd": r("sd", 2)})


@query(f"SELECT cast(l_shipdate AS date) AS day, l_returnflag AS center, {r(f'avg(cos({PHASE}))', 5)} AS mean, {r(f'stddev_pop(cos({PHASE}))', 5)} AS sd, count(*) AS n FROM lineitem WHERE l_suppkey % 40 <> l_partkey % 40 GROUP BY 1, 2")
def stream_daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means of a stream of pair rows that arrive in order; days behind the watermark leave the state."""
    rolled = _drain(_pairs(spark, sf_dir, False), "ts", rollups.daily_rollup, ["day", "center"])
    return select(rolled, {"day": "cast(day AS date)", "center": "center", "mean": r("mean", 5), "sd": r("sd", 5), "n": "n"})


@query(f"""SELECT day, center, {r('avg(c)', 5)} AS mean, {r('quantile_disc(c, 0.5)', 5)} AS median, {r('stddev_pop(c)', 5)} AS sd, count(*) AS n FROM (SELECT cast(l_shipdate AS date) AS day, l_returnflag AS center, cos({PHASE}) AS c, max(cast(l_shipdate AS date)) OVER () AS last FROM lineitem WHERE l_suppkey % 40 <> l_partkey % 40) q WHERE day <= last - 3 GROUP BY 1, 2""")
def stream_closed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means and exact medians of a stream of pair rows, each day once when it is closed; the last days stay open."""
    rolled = _drain(_pairs(spark, sf_dir, False), "ts", lambda p: rollups.closed_days(p, digits=5), closed=True)
    return select(rolled, {"day": "cast(day AS date)", "center": "center", "mean": r("mean", 5), "median": r("median", 5), "sd": r("sd", 5), "n": "n"})


@query(f"SELECT st AS station, w, {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS sd, count(*) AS n FROM (SELECT 's' || (user_id % 8) AS st, value, unnest([cast(floor(epoch_us(ts) / 3600000000) AS bigint), cast(floor(epoch_us(ts) / 3600000000) AS bigint) - 1]) AS w FROM events) q GROUP BY 1, 2")
def stream_sliding_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-hour windows each hour over a stream of events; w is the hour in which a window starts."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "user_id", "value")
    observed = lambda e: e.select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("s"), F.col("user_id") % 8).alias("station"), "value")
    out = _drain(rows, "ts", lambda e: rollups.sliding_statistics(observed(e)), ["start", "station"])
    return select(out, {"station": "station", "w": "cast(unix_seconds(start) / 3600 AS bigint)", "mean": r("mean"), "sd": r("sd"), "n": "n"})
