"""Observations met with something that moves: event windows, a piecewise straight track, and pairs by where their ends lie."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlag.functions import geo
from meshlag.functions.cut import small

#: The shadow's reach in km, the magnitude from which a station is in it, and the phases by minutes from the maximum.
REACH_KM, INSIDE = 2500, 0.1
PHASES = "CASE WHEN {m} < -240 THEN 'baseline' WHEN {m} < -120 THEN 'before' WHEN {m} < -30 THEN 'beginning' WHEN {m} <= 30 THEN 'maximum' WHEN {m} <= 120 THEN 'ending' WHEN {m} <= 240 THEN 'after' ELSE 'recovery' END"


def in_windows(obs: DataFrame, events: DataFrame, half: int, time: str = "t", centre: str = "t0") -> DataFrame:
    """`obs` within `half` seconds of an event, with the event's columns; one row for each event that an observation lies near.

    An event is laid into the time buckets that its window touches, so the join is one of equal buckets, then cut
    to the window. Observations are read once whatever the number of events, and those near none are dropped there.
    """
    width = 2 * half
    bucket = lambda c: F.floor(c / width)
    laid = events.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(centre) - half), bucket(F.col(centre) + half))))
    return obs.withColumn("_bucket", bucket(F.col(time))).join(small(laid), "_bucket").where(F.abs(F.col(time) - F.col(centre)) <= half).drop("_bucket")


def along(minute: str, reach: str = "reach") -> dict[str, str]:
    """The place on a track of three points (start, maximum, end; `reach` minutes on either side), as text of its latitude and longitude."""
    f = f"least(1.0D, abs({minute}) / cast({reach} AS double))"
    ends = lambda c: f"({c}_max + (CASE WHEN {minute} < 0 THEN {c}_start ELSE {c}_end END - {c}_max) * {f})"
    return {"lat0": ends("lat"), "lon0": ends("lon")}


def magnitude(lat: str, lon: str, lat0: str, lon0: str) -> str:
    """How deep a place lies in the shadow: 1 at its centre, 0 from REACH_KM on."""
    return f"greatest(0.0D, least(1.0D, 1 - {geo.great_circle(lat, lon, lat0, lon0)} / {REACH_KM}))"


def pair_class(a: str, b: str) -> str:
    return f"CASE WHEN {a} > {INSIDE} AND {b} > {INSIDE} THEN 'inside' WHEN {a} > {INSIDE} OR {b} > {INSIDE} THEN 'edge' ELSE 'outside' END"


def shadow_pairs(obs: DataFrame, events: DataFrame, places: DataFrame, step_minutes: int, scale: float, least_stations: int) -> DataFrame:
    """(event_id, minute, class, n, mean, spread): likeness of station pairs while the shadow passes, by where the ends lie then.

    Observations (st, t, bias) on a track are averaged by station and step; each station's magnitude is that of its
    place and the track's place at the step's start, so a pair changes its class as the shadow moves. Steps with
    fewer stations are left out, and classes of one pair.
    """
    reach = events.agg(F.max("reach")).first()[0] or 0
    near = in_windows(obs, events, reach * 60).where(F.abs(F.col("t") - F.col("t0")) <= F.col("reach") * 60)
    minute = F.floor((F.col("t") - F.col("t0")) / 60 / step_minutes) * step_minutes
    track = [c for c in events.columns if c not in ("event_id", "t0")]
    means = near.withColumn("minute", minute).groupBy("event_id", "minute", *track, "st").agg(F.avg("bias").alias("m"))
    at = along("minute")
    placed = means.join(small(places), F.col("st") == F.col("id")).withColumns({k: F.expr(v) for k, v in at.items()})
    placed = placed.select("event_id", "minute", "st", "m", F.expr(magnitude("lat", "lon", "lat0", "lon0")).alias("mag"))
    enough = placed.groupBy("event_id", "minute").agg(F.count("*").alias("stations")).where(F.col("stations") >= least_stations).select("event_id", "minute")
    kept = placed.join(enough, ["event_id", "minute"])
    a, b = (kept.select("event_id", "minute", *[F.col(c).alias(f"{c}_{e}") for c in ("st", "m", "mag")]) for e in "ab")
    pairs = a.join(b, ["event_id", "minute"]).where("st_a < st_b")
    alike = pairs.select("event_id", "minute", F.expr(pair_class("mag_a", "mag_b")).alias("class"), (1 / (1 + F.abs(F.col("m_a") - F.col("m_b")) / scale)).alias("c"))
    return alike.groupBy("event_id", "minute", "class").agg(F.count("*").alias("n"), F.avg("c").alias("mean"), F.stddev_pop("c").alias("spread")).where("n > 1")


def deepest(events: DataFrame, places: DataFrame, step_minutes: int) -> DataFrame:
    """(event_id, id, mag): how deep each station comes to lie in the shadow along the whole track."""
    steps = events.withColumn("minute", F.explode(F.expr(f"sequence(-cast(reach AS int), cast(reach AS int), {step_minutes})")))
    steps = steps.select("event_id", *[F.expr(v).alias(k) for k, v in along("minute").items()])
    met = places.join(small(steps), F.lit(True))  # track points are counted before they are sent
    return met.groupBy("event_id", "id").agg(F.max(F.expr(magnitude("lat", "lon", "lat0", "lon0"))).alias("mag"))
