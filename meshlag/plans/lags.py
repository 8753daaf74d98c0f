"""All lags between series, momentary periods and their change around events: SP23, SP25, W9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlag.operators import lags
from meshlag.plans.daily_series import BY_CENTER, by_center
from meshlag.plans.fixtures import events_calendar, events_sql
from meshlag.plans.registry import query, r, select


def standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("center")
    return by_center(spark, sf_dir).select("center", "t", ((F.col("m") - F.avg("m").over(w)) / F.stddev_pop("m").over(w)).alias("z"))


_z = f"(SELECT center, t, (m - avg(m) OVER w) / stddev_pop(m) OVER w AS z FROM {BY_CENTER} b WINDOW w AS (PARTITION BY center))"
_lags = f"(SELECT x.center AS a, y.center AS b, cast(y.t - x.t AS bigint) AS lag, sum(x.z * y.z) AS total, count(*) AS n FROM {_z} x JOIN {_z} y ON x.center < y.center GROUP BY 1, 2, 3)"


@query(f"SELECT a, b, lag, {r('total / n', 5)} AS r, n FROM {_lags} l")
def lag_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of every two centres at every lag."""
    return select(lags.all_lags(standard(spark, sf_dir), "center", "t", "z"), {"a": "a", "b": "b", "lag": "lag", "r": r("total / n", 5), "n": "n"})


@query(f"SELECT a, b, lag, {r('total', 3)} AS total, CASE WHEN total < 0 THEN 'anti_phase' ELSE 'in_phase' END AS kind FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY round(abs(total), 6) DESC, abs(lag), lag) AS k FROM {_lags} l) q WHERE k = 1")
def best_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lag at which two centres agree or oppose each other most."""
    all_ = lags.all_lags(standard(spark, sf_dir), "center", "t", "z")
    best = all_.groupBy("a", "b").agg(F.min_by(F.struct("lag", "total"), F.struct(-F.round(F.abs("total"), 6), F.abs("lag"), "lag")).alias("x")).select("a", "b", "x.*")
    return select(best, {"a": "a", "b": "b", "lag": "lag", "total": r("total", 3), "kind": "CASE WHEN total < 0 THEN 'anti_phase' ELSE 'in_phase' END"})


#: Bands in days; SHIFTS shifted calendars.
PERIODS, SHIFTS = {"27d": 27.3, "56d": 56.0, "112d": 112.0}, 200
_bands = ", ".join(f"('{n}', {p!r}::double)" for n, p in PERIODS.items())
_waves = f"""(SELECT d.center, period, p, d.t, sum(g * m * cos(2 * pi() * s / p)) / sum(g) AS re, -sum(g * m * sin(2 * pi() * s / p)) / sum(g) AS im FROM (
    SELECT d.center, period, p, d.t, s.t AS s, s.m, exp(-0.5 * pow((d.t - s.t) / p, 2)) AS g FROM {BY_CENTER} d JOIN {BY_CENTER} s ON s.center = d.center, (VALUES {_bands}) v(period, p) WHERE abs(d.t - s.t) <= ceil(3 * p)) d GROUP BY 1, 2, 3, 4)"""
_turned = f"""(SELECT *, sqrt(re * re + im * im) AS amplitude, atan2(lead(im) OVER w * lag(re) OVER w - lead(re) OVER w * lag(im) OVER w, lead(re) OVER w * lag(re) OVER w + lead(im) OVER w * lag(im) OVER w) / (lead(t) OVER w - lag(t) OVER w) AS turn
    FROM {_waves} z WINDOW w AS (PARTITION BY center, period ORDER BY t))"""
_moment = f"(SELECT *, CASE WHEN 1 / p + turn / (2 * pi()) > 1 / (10 * p) THEN 1 / (1 / p + turn / (2 * pi())) END AS momentary FROM {_turned} y)"
_gated = f"(SELECT center, period, t, amplitude, turn, momentary, CASE WHEN amplitude >= quantile_cont(amplitude, 0.6) OVER (PARTITION BY center, period) THEN momentary END AS kept, row_number() OVER (PARTITION BY center, period ORDER BY t) AS k, count(*) OVER (PARTITION BY center, period) AS n FROM {_moment} x)"


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lags.momentary_period(lags.demodulate(by_center(spark, sf_dir), ["center"], "t", "m", PERIODS), ["center"], "t")


_wave = {"center": "center", "period": "period", "t": "t", "amplitude": r("amplitude"), "turn": r("turn", 5)}


@query(f"SELECT {', '.join(f'{v} AS {k}' for k, v in _wave.items())} FROM {_turned} z")
def demodulated_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amplitude and turning of a centre's daily series against steady waves of some periods."""
    return select(waves(spark, sf_dir), _wave)


_spread = "stddev_pop(CASE WHEN abs(d) <= 15 THEN kept END) - stddev_pop(CASE WHEN abs(d) > 15 THEN kept END)"
_shifted = f"""(SELECT center, period, shift, ev, CASE WHEN count(CASE WHEN abs(d) <= 15 THEN kept END) >= 5 AND count(CASE WHEN abs(d) > 15 THEN kept END) >= 20 THEN {_spread} END AS e FROM (
    SELECT g.center, g.period, shift, v.k AS ev, g.k - ((v.k - 1 + shift * {lags.PRIME_STEP}) % v.n + 1) AS d, g.kept
    FROM {_gated} v JOIN (SELECT {"date_diff('day', date '1995-01-01', event_date)"} AS te FROM {events_sql()} q) c ON c.te = v.t, range(0, {SHIFTS + 1}) s(shift), {_gated} g WHERE g.center = v.center AND g.period = v.period AND abs(g.k - ((v.k - 1 + shift * {lags.PRIME_STEP}) % v.n + 1)) <= 75) p GROUP BY 1, 2, 3, 4)"""
_effects = f"(SELECT center, period, shift, count(e) AS events, avg(e) AS effect FROM {_shifted} w GROUP BY 1, 2, 3)"
_locked = {"center": "center", "period": "period", "events": "events", "effect": r("effect", 4), "p_value": r("p_value", 4)}


@query(f"""SELECT {', '.join(f'{v} AS {k}' for k, v in _locked.items())} FROM (SELECT a.center, a.period, b.events, b.effect, (sum(CASE WHEN a.effect >= b.effect - 1e-9 THEN 1 ELSE 0 END) + 1) / (count(a.effect) + 1.0::double) AS p_value
    FROM {_effects} a JOIN {_effects} b ON a.center = b.center AND a.period = b.period AND b.shift = 0 WHERE a.shift > 0 GROUP BY 1, 2, 3, 4) u""")
def event_locked_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a band's momentary period varies more around events than beside them, against shifted calendars."""
    found = lags.gated(waves(spark, sf_dir), ["center", "period"], "amplitude", "momentary", 0.6)
    events = events_calendar(spark, sf_dir).select(F.datediff("event_date", F.lit("1995-01-01").cast("date")).alias("t"))
    asked = found.select("center", "period").distinct().join(F.broadcast(events), F.lit(True))  # a dozen events
    return select(lags.event_locked(found, ["center", "period"], "t", "momentary", asked, SHIFTS), _locked)
