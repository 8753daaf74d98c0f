"""Station-mesh tables derived from the driver's business tables, for Spark and as SQL text.

clock: 6-hourly means of event values for 8 stations; station: 40 places; pair_day: a row for each line item
between two places with a pseudo phase; daily: external daily indices from the orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlag.functions import geo
from meshlag.functions.bins import distance_bin
from meshlag.functions.cut import small

PHASE = "2 * pi() * (((l_orderkey * 7 + l_linenumber * 13) % 1000) / cast(1000 AS double)) - pi()"
STATION = "cast((id * 37) % 140 - 70 AS double) AS lat, cast((id * 73) % 360 - 180 AS double) AS lon, cast((id * 211) % 2500 AS double) AS height_m, cast((id * 37) % 140 - 70 AS double) * 0.9 AS geomag_lat"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clock(spark: SparkSession, sf_dir: str, seconds: int = 21_600, stations: int = 8) -> DataFrame:
    """(st, e, bias): mean value of station st in epoch e."""
    events = read(spark, sf_dir, "events").select((F.col("user_id") % stations).alias("st"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / seconds).cast("long").alias("e"), "value")
    return events.groupBy("st", "e").agg(F.avg("value").alias("bias"))


def clock_sql(seconds: int = 21_600, stations: int = 8) -> str:
    return f"(SELECT user_id % {stations} AS st, cast(floor(epoch_us(ts) / 1e6 / {seconds}) AS bigint) AS e, avg(value) AS bias FROM events GROUP BY 1, 2)"


def station(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "part").select((F.col("p_partkey") % 40).alias("id")).distinct()
    return ids.selectExpr("id", *STATION.split(", "))


STATION_SQL = f"(SELECT id, {STATION} FROM (SELECT DISTINCT p_partkey % 40 AS id FROM part))"
DIST = geo.great_circle("lat_i", "lon_i", "lat_j", "lon_j")


def pair_day(spark: SparkSession, sf_dir: str, places: bool = True) -> DataFrame:
    """(row, center, date, i, j, phase, coherence) with coordinates and dist_km; i < j."""
    base = read(spark, sf_dir, "lineitem").where("l_suppkey % 40 <> l_partkey % 40").selectExpr(
        "l_orderkey * 10 + l_linenumber AS row", "l_returnflag AS center", "cast(l_shipdate AS date) AS date",
        "least(l_suppkey % 40, l_partkey % 40) AS i", "greatest(l_suppkey % 40, l_partkey % 40) AS j", f"{PHASE} AS phase", f"cos({PHASE}) AS coherence",
    )
    return base.join(small(pair_places(spark, sf_dir)), ["i", "j"]).drop("bin") if places else base


def pair_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j) with the places of both ends, dist_km and bin: geometry depends on the pair alone, so it is worked out once for each pair."""
    s = station(spark, sf_dir)
    a, b = (s.select(F.col("id").alias(e), F.col("lat").alias(f"lat_{e}"), F.col("lon").alias(f"lon_{e}"), F.col("height_m").alias(f"h_{e}"), F.col("geomag_lat").alias(f"gm_{e}")) for e in "ij")
    return a.join(b, F.col("i") < F.col("j")).withColumn("dist_km", F.expr(DIST)).withColumn("bin", distance_bin("dist_km"))


def binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid pair rows with their distance bin; pairs without one are dropped from the pair table before the join."""
    pairs = pair_places(spark, sf_dir).where("dist_km > 0 AND bin IS NOT NULL")
    return pair_day(spark, sf_dir, False).where("phase IS NOT NULL").join(small(pairs), ["i", "j"])


PAIR_DAY_SQL = f"""(SELECT p.*, a.lat AS lat_i, a.lon AS lon_i, a.height_m AS h_i, a.geomag_lat AS gm_i, b.lat AS lat_j, b.lon AS lon_j, b.height_m AS h_j, b.geomag_lat AS gm_j,
    {geo.great_circle('a.lat', 'a.lon', 'b.lat', 'b.lon').replace('.0D', '.0')} AS dist_km
  FROM (SELECT l_orderkey * 10 + l_linenumber AS row, l_returnflag AS center, cast(l_shipdate AS date) AS date, least(l_suppkey % 40, l_partkey % 40) AS i, greatest(l_suppkey % 40, l_partkey % 40) AS j,
        {PHASE} AS phase, cos({PHASE}) AS coherence FROM lineitem WHERE l_suppkey % 40 <> l_partkey % 40) p
  JOIN {STATION_SQL} a ON a.id = p.i JOIN {STATION_SQL} b ON b.id = p.j)"""


#: Whole cents are summed, so that the indices don't depend on the order of the sum: no rounding edge decides them.
_activity = {"kp_index": "cast(cents // n % 900 AS double) / 100", "f107_flux": "cast(65 + n AS double)", "ap_index": "cast(cents // 100 % 40 AS double)"}


def external_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date"), F.round(F.col("o_totalprice") * 100).cast("long").alias("c"))
    sums = orders.groupBy("date").agg(F.sum("c").alias("cents"), F.count("*").alias("n"))
    return sums.selectExpr("date", *[f"{v.replace('//', 'DIV')} AS {k}" for k, v in _activity.items()])


EXTERNAL_SQL = f"(SELECT date, {', '.join(f'{v} AS {k}' for k, v in _activity.items())} FROM (SELECT cast(o_orderdate AS date) AS date, cast(sum(cast(round(o_totalprice * 100) AS bigint)) AS bigint) AS cents, count(*) AS n FROM orders GROUP BY 1) s)"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair_day(spark, sf_dir, places=False)
    return p.groupBy("date").agg(F.avg("coherence").alias("m"), F.stddev_pop("coherence").alias("sd"), F.count("*").alias("n"))


DAILY_SQL = f"(SELECT date, avg(coherence) AS m, stddev_pop(coherence) AS sd, count(*) AS n FROM (SELECT cast(l_shipdate AS date) AS date, cos({PHASE}) AS coherence FROM lineitem WHERE l_suppkey % 40 <> l_partkey % 40) GROUP BY 1)"


def events_calendar(spark: SparkSession, sf_dir: str, months: tuple[int, ...] = (3, 9)) -> DataFrame:
    """(event_id, event_date): the 15th of some months in every year of the shipments."""
    days = read(spark, sf_dir, "lineitem").selectExpr("cast(l_shipdate AS date) AS d").distinct()
    return days.where(F.dayofmonth("d") == 15).where(F.month("d").isin(*months)).selectExpr("year(d) * 100 + month(d) AS event_id", "d AS event_date")


def events_sql(months: tuple[int, ...] = (3, 9)) -> str:
    return f"(SELECT DISTINCT year(l_shipdate) * 100 + month(l_shipdate) AS event_id, cast(l_shipdate AS date) AS event_date FROM lineitem WHERE day(l_shipdate) = 15 AND month(l_shipdate) IN ({', '.join(map(str, months))}))"
