"""Samples, stored facts, places by any name, and reports that join results: L5, P13, R5, S8, C1, C25, C26, C31-C33."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlag.config import DEFAULT
from meshlag.functions import geo
from meshlag.functions.bins import accumulate
from meshlag.functions.cut import cut, remove, shared_folder
from meshlag.operators import fit, resample
from meshlag.operators.steps import nest
from meshlag.plans import daily_series, decay, events, inference, resampling, spectra
from meshlag.plans.decay import ERRORS, RANKED, bins, bins_sql
from meshlag.plans.fixtures import PAIR_DAY_SQL, STATION_SQL, binned, pair_day, station
from meshlag.plans.pairs import BINNED
from meshlag.plans.registry import ORACLE_SQL, query, r, select
from meshlag.sources.tables import read_pairs, with_places, write_pairs

_month = "year(date) * 12 + month(date)"


@query(f"SELECT month, n_train, n_held, n_train >= {DEFAULT.least_train} AND n_held >= {DEFAULT.least_held} AS sufficient FROM (SELECT month, n AS n_held, cast(sum(n) OVER () - n AS bigint) AS n_train FROM (SELECT {_month} AS month, count(*) AS n FROM {BINNED} b WHERE bin BETWEEN 0 AND 39 GROUP BY 1) q) z")
def fold_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months as folds: those with enough rows to hold out and to train on."""
    states = cut(accumulate(binned(spark, sf_dir).withColumn("month", F.expr(_month)), ["month"]))
    return resample.sufficient(states, "month", DEFAULT.least_train, DEFAULT.least_held)


FRACTION, SEED = 0.05, 42


@query(f"SELECT row, center, {r('coherence')} AS coherence FROM {PAIR_DAY_SQL} p WHERE cast('0x' || substr(md5(row || '#{SEED}'), 1, 8) AS bigint) < {int(FRACTION * (1 << 32))}")
def sampled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of the pair rows: sampling is the operator."""
    p = resample.row_sample(pair_day(spark, sf_dir, False), "row", FRACTION, SEED)
    return select(p, {"row": "row", "center": "center", "coherence": r("coherence")})


_named = [{"lat_0": "CASE WHEN id % 3 = 0 THEN lat END", "lat_deg": "CASE WHEN id % 3 = 1 THEN lat END", "lon_0": "CASE WHEN id % 3 = 0 THEN lon END", "longitude": "CASE WHEN id % 3 = 1 THEN lon END", **{f"{c}_m": f"CASE WHEN id % 3 = 2 THEN {x} END" for c, x in geo.geodetic_to_ecef("lat", "lon", "height_m").items()}}]
_placed = f"(SELECT id, coalesce(lat_0, lat_deg, lat_closed) AS lat, coalesce(lon_0, longitude, lon_closed) AS lon FROM {nest(nest(STATION_SQL, _named), geo.ecef_closed_form('x_m', 'y_m', 'z_m'))} g)"


@query(f"SELECT a.id AS i, b.id AS j, {r(geo.great_circle('a.lat', 'a.lon', 'b.lat', 'b.lon'), 4)} AS dist_km FROM {_placed} a JOIN {_placed} b ON a.id < b.id")
def coalesced_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of stations whose places come under different names or as geocentric metres only."""
    s = station(spark, sf_dir)
    for k, x in _named[0].items():
        s = s.withColumn(k, F.expr(x))
    s = with_places(s.drop("lat", "lon").withColumnsRenamed({"lat_0": "lat", "lon_0": "lon"}))
    a, b = (s.select(F.col("id").alias(e), F.col("place_lat").alias(f"lat_{e}"), F.col("place_lon").alias(f"lon_{e}")) for e in "ij")
    return select(a.join(b, F.col("i") < F.col("j")), {"i": "i", "j": "j", "dist_km": r(geo.great_circle("lat_i", "lon_i", "lat_j", "lon_j"), 4)})


@query(f"SELECT center, {_month} AS month, count(*) AS n, {r('avg(coherence)')} AS mean_coherence FROM {PAIR_DAY_SQL} p GROUP BY 1, 2")
def stored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair facts written by centre and month, and read again."""
    path = f"{shared_folder(spark)}/pairs-{uuid.uuid4().hex}"
    write_pairs(pair_day(spark, sf_dir, False), path)
    out = cut(read_pairs(spark, path).groupBy("center", F.expr(_month).alias("month")).agg(F.count("*").alias("n"), F.expr(r("avg(coherence)")).alias("mean_coherence")))
    remove(spark, path)
    return out


_best = f"(SELECT center, model AS best_model FROM (SELECT *, row_number() OVER (PARTITION BY center ORDER BY round(aic, 3), model) AS k FROM ({decay._ranked}) u) q WHERE k = 1)"
_dropped = fit.fit_decay_sql(f"(SELECT a.*, b.bin AS dropped FROM {bins_sql('center')} a JOIN {bins_sql('center')} b ON a.center = b.center AND a.bin <> b.bin)", ["center", "dropped"])
_jack = f"(SELECT center, count(*) AS refits, avg(theta) AS jack_mean, stddev_pop(theta) AS jack_sd FROM {_dropped} f WHERE amplitude > 0.0001 GROUP BY center)"
_volume = f"(SELECT center, count(*) AS bins, cast(sum(n) AS bigint) AS n FROM {bins_sql('center')} b GROUP BY 1)"
_report = {"center": "center", "n": "n", "bins": "bins", "best_model": "best_model", **decay.THETA, "se_theta": r("CASE WHEN amplitude > 0.0001 THEN se_theta END", 0), "refits": "refits", "jack_mean": r("jack_mean", 1), "jack_sd": r("jack_sd", 0)}
INTERVAL = ("amplitude_low", "amplitude_middle", "amplitude_high")
_report |= {"replicates": "replicates", **{k: k for k in INTERVAL}}


@query(f"SELECT {', '.join(f'{v} AS {k}' for k, v in _report.items())} FROM {_volume} v JOIN {_best} b USING (center) JOIN {ERRORS} e USING (center) LEFT JOIN {_jack} j USING (center) LEFT JOIN ({ORACLE_SQL['block_bootstrap']}) i USING (center)")
def center_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each centre's whole decay analysis in one row: volume, best model, length with its error, the drop-one-bin spread, the bootstrap's interval."""
    b = cut(bins(spark, sf_dir, ["center"]))
    volume = b.groupBy("center").agg(F.count("*").alias("bins"), F.sum("n").alias("n"))
    best = fit.fit_all(b, ["center"], RANKED).groupBy("center").agg(F.min_by("model", F.struct(F.round("aic", 3), "model")).alias("best_model"))
    errors = fit.fit_decay(b, ["center"], errors=True).select("center", "theta", "amplitude", "se_theta")
    dropped = b.join(b.select("center", F.col("bin").alias("dropped")), "center").where("bin <> dropped")
    jack = fit.fit_decay(dropped, ["center", "dropped"]).where("amplitude > 0.0001").groupBy("center").agg(F.count("*").alias("refits"), F.avg("theta").alias("jack_mean"), F.stddev_pop("theta").alias("jack_sd"))
    interval = resampling.interval_of(b, DEFAULT.bootstrap).select("center", "replicates", *INTERVAL)
    return select(volume.join(best, "center").join(errors, "center").join(jack, "center", "left").join(interval, "center", "left"), _report)


#: Check, query it rests on, share of its rows or value, and when it passes.
CHECKS = [
    ("centres_agree", resampling.multi_center_consistency, "max(cv)", "value < 0.2"),
    ("weights_agree", inference.cross_method_agreement, "avg(CASE WHEN consistent THEN 1.0D ELSE 0.0D END)", "value = 1"),
    ("no_zero_lag", spectra.zero_lag_comparison, "max(CASE WHEN zero_lag_suspect THEN 1.0D ELSE 0.0D END)", "value = 0"),
    ("months_predict", resampling.monthly_cross_validation, "avg(r2)", "value > 0"),
    ("stations_predict", resampling.station_block_cross_validation, "avg(r2)", "value > 0"),
    ("folds_suffice", fold_sufficiency, "avg(CASE WHEN sufficient THEN 1.0D ELSE 0.0D END)", "value = 1"),
    ("events_stand_out", events.event_effects, "avg(CASE WHEN abs(effect) > 1 THEN 1.0D ELSE 0.0D END)", "value > 0.5"),
    ("activity_unrelated", daily_series.external_correlations, "max(abs(r_kp))", "value < 0.1"),
]
_checks = " UNION ALL ".join(f"SELECT '{name}' AS check_name, cast({value} AS double) AS value FROM ({ORACLE_SQL[f.__name__]}) q" for name, f, value, _ in CHECKS)
_passes = "CASE check_name " + " ".join(f"WHEN '{name}' THEN {test}" for name, _, _, test in CHECKS) + " END"


@query(f"SELECT check_name, {r('value', 3)} AS value, coalesce({_passes}, false) AS passed FROM ({_checks}) c")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts of the validations side by side, each from its own query."""
    out = None
    for name, f, value, _ in CHECKS:
        one = f(spark, sf_dir).agg(F.expr(f"cast({value} AS double)").alias("value")).select(F.lit(name).alias("check_name"), "value")
        out = one if out is None else out.unionByName(one)
    return select(out, {"check_name": "check_name", "value": r("value", 3), "passed": f"coalesce({_passes}, false)"})


@query(f"SELECT count(*) AS checks, cast(sum(CASE WHEN passed THEN 1 ELSE 0 END) AS bigint) AS passed, CASE WHEN avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END) >= 0.75 THEN 'supported' WHEN avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END) >= 0.5 THEN 'mixed' ELSE 'unsupported' END AS verdict FROM ({ORACLE_SQL['validation_report']}) v")
def combined_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row over the report."""
    v = validation_report(spark, sf_dir).agg(F.count("*").alias("checks"), F.sum(F.col("passed").cast("int")).alias("passed"))
    share = F.col("passed") / F.col("checks")
    return v.withColumn("verdict", F.when(share >= 0.75, "supported").when(share >= 0.5, "mixed").otherwise("unsupported"))
