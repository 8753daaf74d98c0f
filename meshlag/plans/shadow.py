"""Coherence while a shadow passes: C15, SP12."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlag.operators import moving, spectral
from meshlag.plans.fixtures import STATION_SQL, clock, clock_sql, read, station
from meshlag.plans.registry import query, r, select

STATIONS, STEP, SCALE, LEAST, HALF_DAY = 40, 20, 100.0, 4, 43_200
_day = "cast(floor(epoch_us(ts) / 86400000000) AS bigint)"
#: A shadow at noon of every third day: it comes from the south-west and leaves to the south-east.
TRACK = {"t0": "d * 86400 + 43200", "reach": "120", "lat_max": "cast(d * 17 % 100 - 50 AS double)", "lon_max": "cast(d * 47 % 360 - 180 AS double)"}
TRACK |= {"lat_start": "cast(d * 17 % 100 - 58 AS double)", "lon_start": "cast(d * 47 % 360 - 220 AS double)", "lat_end": "cast(d * 17 % 100 - 56 AS double)", "lon_end": "cast(d * 47 % 360 - 130 AS double)"}


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = read(spark, sf_dir, "events").select(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).alias("d")).distinct().where("d % 3 = 0")
    return days.selectExpr("d AS event_id", *[f"{v} AS {k}" for k, v in TRACK.items()])


TRACKS_SQL = f"(SELECT d AS event_id, {', '.join(f'{v} AS {k}' for k, v in TRACK.items())} FROM (SELECT DISTINCT {_day} AS d FROM events) q WHERE d % 3 = 0)"


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select((F.col("user_id") % STATIONS).alias("st"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("value").alias("bias"))


READINGS_SQL = f"(SELECT user_id % {STATIONS} AS st, epoch_us(ts) / 1e6 AS t, value AS bias FROM events)"
_at = moving.along("minute")
_means = f"""(SELECT e.event_id, minute, st, m, {moving.magnitude('lat', 'lon', 'lat0', 'lon0')} AS mag FROM (
    SELECT e.*, minute, st, m, {', '.join(f'{v} AS {k}' for k, v in _at.items())} FROM (
        SELECT event_id AS ev, cast(floor((t - t0) / 60 / {STEP}) * {STEP} AS bigint) AS minute, st, avg(bias) AS m FROM {READINGS_SQL} o JOIN {TRACKS_SQL} w ON abs(t - t0) <= reach * 60 GROUP BY 1, 2, 3) x JOIN {TRACKS_SQL} e ON e.event_id = x.ev) e JOIN {STATION_SQL} s ON s.id = e.st)"""
_kept = f"(SELECT *, count(*) OVER (PARTITION BY event_id, minute) AS stations FROM {_means} m)"
_steps = f"""(SELECT event_id, minute, class, count(*) AS n, avg(c) AS mean, stddev_pop(c) AS spread FROM (
    SELECT a.event_id, a.minute, {moving.pair_class('a.mag', 'b.mag')} AS class, 1 / (1 + abs(a.m - b.m) / {SCALE}) AS c FROM {_kept} a JOIN {_kept} b ON a.event_id = b.event_id AND a.minute = b.minute AND a.st < b.st WHERE a.stations >= {LEAST}) p GROUP BY 1, 2, 3 HAVING count(*) > 1)"""
_by_step = {"event_id": "event_id", "minute": "cast(minute AS bigint)", "class": "class", "n": "n", "mean_coherence": r("mean"), "spread": r("spread")}
_by_phase = {"steps": "count(*)", "mean_coherence": r("avg(mean)"), "mean_pairs": r("avg(n)", 3)}
_phase = moving.PHASES.format(m="minute")


@query(f"SELECT {', '.join(f'{v} AS {k}' for k, v in _by_step.items())} FROM {_steps} z")
def shadow_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of pairs inside, at the edge of and outside the moving shadow, for every step of a passage."""
    return select(moving.shadow_pairs(readings(spark, sf_dir), tracks(spark, sf_dir), station(spark, sf_dir), STEP, SCALE, LEAST), _by_step)


@query(f"SELECT {_phase} AS phase, class, {', '.join(f'{v} AS {k}' for k, v in _by_phase.items())} FROM {_steps} z GROUP BY 1, 2")
def shadow_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all passages, by phase of the passage and where the pair lies."""
    steps = moving.shadow_pairs(readings(spark, sf_dir), tracks(spark, sf_dir), station(spark, sf_dir), STEP, SCALE, LEAST)
    return steps.groupBy(F.expr(_phase).alias("phase"), "class").agg(*[F.expr(v).alias(k) for k, v in _by_phase.items()])


_hours = f"(SELECT event_id AS ev, st, e, bias FROM {clock_sql(3600, 20)} c JOIN {TRACKS_SQL} w ON abs(e * 3600 - t0) <= {HALF_DAY})"
_deep = f"(SELECT event_id, id, max({moving.magnitude('lat', 'lon', 'lat0', 'lon0')}) AS mag FROM (SELECT event_id, {', '.join(f'{v} AS {k}' for k, v in _at.items())} FROM {TRACKS_SQL} t, range(-120, 121, 10) r(minute)) z, {STATION_SQL} s GROUP BY 1, 2)"
_exposed = {"event_id": "event_id", "class": "class", "pairs": "count(*)", "mean_coherence": r("avg(cos(phase))", 4), "spread": r("stddev_pop(cos(phase))", 4), "mean_epochs": r("avg(n_epochs)", 3)}


@query(f"SELECT {', '.join(f'{v} AS {k}' for k, v in _exposed.items())} FROM (SELECT p.ev AS event_id, n_epochs, phase, {moving.pair_class('a.mag', 'b.mag')} AS class FROM {spectral.common_phases_sql(_hours, 'ev', 8, [1, 2], 10)} p JOIN {_deep} a ON a.event_id = p.ev AND a.id = p.i JOIN {_deep} b ON b.event_id = p.ev AND b.id = p.j WHERE phase IS NOT NULL) q GROUP BY 1, 2")
def event_window_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band phases of all pairs in the half days around each passage, by how many ends the shadow comes to cover."""
    events, places = tracks(spark, sf_dir), station(spark, sf_dir)
    hours = clock(spark, sf_dir, 3600, 20).withColumn("t", F.col("e") * 3600)
    near = moving.in_windows(hours, events.select("event_id", "t0"), HALF_DAY).select("event_id", "st", "e", "bias")
    pairs = spectral.phases(near, ["event_id"], 8, [1, 2], 10).where("phase IS NOT NULL")
    depth = moving.deepest(events, places, 10)
    for e in "ij":
        pairs = pairs.join(depth.select("event_id", F.col("id").alias(e), F.col("mag").alias(f"mag_{e}")), ["event_id", e])
    found = pairs.withColumn("class", F.expr(moving.pair_class("mag_i", "mag_j"))).groupBy("event_id", "class")
    return found.agg(*[F.expr(v).alias(k) for k, v in _exposed.items() if k not in ("event_id", "class")])
