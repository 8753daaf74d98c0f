"""Decay fits over the bins: M1-M20, C1, C2, C10, C17, C18."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlag.functions import geo
from meshlag.functions.bins import accumulate, finalise
from meshlag.functions.cut import cut
from meshlag.operators import fit
from meshlag.operators.resample import shuffled_rank
from meshlag.operators.steps import nest
from meshlag.plans.fixtures import PAIR_DAY_SQL, binned, pair_day
from meshlag.plans.pairs import AZ, BINNED, STATES
from meshlag.plans.registry import query, r, select


def bins(spark: SparkSession, sf_dir: str, keys: list[str], least: int = 50) -> DataFrame:
    return finalise(accumulate(binned(spark, sf_dir), keys), least)


def bins_sql(keys: str, source: str = BINNED, least: int = 50) -> str:
    return f"(SELECT {keys}, bin, sum(coherence) / count(*) AS mean_coherence, sum(dist_km) / count(*) AS distance_km, count(*) AS n FROM {source} b WHERE bin BETWEEN 0 AND 39 GROUP BY {keys}, bin HAVING count(*) >= {least})"


FIT = {"amplitude": r("amplitude", 4), "offset_c": r("offset_c", 4), "wrss": r("wrss", 3), "r2": r("r2", 4), "aic": r("aic", 3), "n_bins": "n_bins"}


def _text(keys: list[str]) -> str:
    return ", ".join([*keys, *(f"{v} AS {k}" for k, v in FIT.items())])


def _out(df: DataFrame, keys: list[str]) -> DataFrame:
    return select(df, {**{k: k for k in keys}, **FIT})


@query(f"SELECT {_text(['center'])} FROM {fit.fit_decay_sql(bins_sql('center'), ['center'])} f")
def decay_fit_by_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(fit.fit_decay(bins(spark, sf_dir, ["center"]), ["center"]), ["center"])


def _model_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _out(fit.fit_decay(bins(spark, sf_dir, ["center"]), ["center"], name), ["center"])

    run.__name__ = f"decay_fit_{name}"
    return query(f"SELECT {_text(['center'])} FROM {fit.fit_decay_sql(bins_sql('center'), ['center'], name)} f")(run)


for _name in ("gaussian", "squared_exponential", "power_law", "matern_1_5", "matern_2_5", "power_law_shifted"):
    _model_query(_name)


#: A decay length means something only where the amplitude does.
THETA = {"theta": r("CASE WHEN amplitude > 0.0001 THEN theta END", 1)}
FITS = {**THETA, **FIT}


def fits_text(keys: list[str], source: str, model: str | fit.Model = "exponential", more: str = "", **names: str) -> str:
    """The fits of every group as text, with the decay length."""
    return f"SELECT {', '.join([*keys, *(f'{v} AS {k}' for k, v in FITS.items())])}{more} FROM {fit.fit_decay_sql(source, keys, model, **names)} f"


def fits_of(df: DataFrame, keys: list[str], more: dict[str, str] | None = None) -> DataFrame:
    return select(df, {**{k: k for k in keys}, **FITS, **(more or {})})


RANKED = [*[m for m in fit.MODELS.values() if m.name != "power_law_shifted"], *fit.cutoff_models()]
_ranked = " UNION ALL ".join(f"SELECT center, '{m.name}' AS model, aic FROM {fit.fit_decay_sql(bins_sql('center'), ['center'], m)} f" for m in RANKED)


@query(f"SELECT center, model, {r('aic', 2)} AS aic, {r('aic - min(aic) OVER (PARTITION BY center)', 2)} AS delta_aic, rank() OVER (PARTITION BY center ORDER BY round(aic, 3)) AS rank FROM ({_ranked}) u")
def model_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All models with the difference in AIC and the rank; includes power laws with a cut-off."""
    b = fit.fit_all(bins(spark, sf_dir, ["center"]), ["center"], RANKED)
    return select(b.withColumn("rank", F.rank().over(Window.partitionBy("center").orderBy(F.round("aic", 3)))), {"center": "center", "model": "model", "aic": r("aic", 2), "delta_aic": r("delta_aic", 2), "rank": "rank"})


_g, _d = "exp(-b.distance_km / f.theta)", "f.amplitude * b.distance_km / (f.theta * f.theta) * exp(-b.distance_km / f.theta)"
_error = "sqrt(wrss / (n_bins - 3) / (e_dd - (e_gd * e_gd * e_w - 2 * e_gd * e_d * e_g + e_d * e_d * e_gg) / (e_gg * e_w - e_g * e_g)))"


ERRORS = f"""(SELECT center, theta, amplitude, {_error} AS se_theta FROM (
    SELECT f.center, any_value(f.theta) AS theta, any_value(f.amplitude) AS amplitude, any_value(f.wrss) AS wrss, any_value(f.n_bins) AS n_bins, sum(n) AS e_w, sum(n * {_g}) AS e_g, sum(n * {_g} * {_g}) AS e_gg, sum(n * {_d}) AS e_d, sum(n * {_g} * {_d}) AS e_gd, sum(n * {_d} * {_d}) AS e_dd
    FROM {bins_sql('center')} b JOIN {fit.fit_decay_sql(bins_sql('center'), ['center'])} f ON f.center = b.center GROUP BY f.center) s)"""


@query(f"SELECT center, {THETA['theta']} AS theta, {r('CASE WHEN amplitude > 0.0001 THEN se_theta END', 0)} AS se_theta FROM {ERRORS} e")
def decay_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential fits with the standard error of the decay length; the twin takes the slope in closed form."""
    f = fit.fit_decay(bins(spark, sf_dir, ["center"]), ["center"], errors=True)
    return select(f, {"center": "center", **THETA, "se_theta": r("CASE WHEN amplitude > 0.0001 THEN se_theta END", 0)})


_named = {"d": _d, "g": _g, "1": "1"}
_products = {f"e_{x}{y}": f"sum(n * {_named[x]} * {_named[y]})" for x, y in ("dd", "dg", "d1", "gg", "g1", "11")}
COVARIED = f"""(SELECT f.center, any_value(f.theta) AS theta, any_value(f.amplitude) AS amplitude, any_value(f.wrss) AS wrss, any_value(f.n_bins) AS n_bins, {', '.join(f'{v} AS {k}' for k, v in _products.items())}
    FROM {bins_sql('center')} b JOIN {fit.fit_decay_sql(bins_sql('center'), ['center'])} f ON f.center = b.center GROUP BY f.center)"""
#: The length's error runs with its square where the amplitude is small, so it is compared in relation to it.
_covariance = {"se_theta_pct": r("100 * se_theta / theta", 2), **{k: r(k, d) for k, d in (("se_amplitude", 6), ("se_offset_c", 6), ("corr_theta_amplitude", 3), ("corr_theta_offset_c", 3), ("corr_amplitude_offset_c", 3))}}
_covariance = {k: f"CASE WHEN amplitude > 0.0001 THEN {v} END" for k, v in _covariance.items()}


@query(f"SELECT center, {', '.join(f'{v} AS {k}' for k, v in _covariance.items())} FROM {nest(COVARIED, fit.COVARIANCE)} e")
def decay_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard errors and correlations of all three parameters; the twin takes the slope in closed form."""
    f = fit.fit_decay(bins(spark, sf_dir, ["center"]), ["center"], errors=True)
    return select(f, {"center": "center", **_covariance})


_cutoff = {"amplitude": r("amplitude", 3), "wrss": r("wrss", 3), "r2": r("r2", 4), "aic": r("aic", 2), "n_bins": "n_bins"}


@query(f"SELECT center, {', '.join(f'{v} AS {k}' for k, v in _cutoff.items())} FROM {fit.fit_cutoff_sql(bins_sql('center'), ['center'])} f")
def decay_fit_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power law with an exponential cut-off, exponent and cut-off fitted together."""
    return select(fit.fit_cutoff(bins(spark, sf_dir, ["center"]), ["center"]), {"center": "center", **_cutoff})


_sectors = f"(SELECT *, {geo.sector(AZ)} AS sector FROM {BINNED} q)"


@query(f"SELECT {_text(['sector'])} FROM {fit.fit_decay_sql(bins_sql('sector', _sectors, 20), ['sector'])} f")
def sector_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = binned(spark, sf_dir).withColumn("sector", F.expr(geo.sector(AZ)))
    return _out(fit.fit_decay(finalise(accumulate(b, ["sector"]), 20), ["sector"]), ["sector"])


@query(f"SELECT {r('avg(amplitude)', 4)} AS mean_amplitude, {r('stddev_pop(amplitude)', 4)} AS sd_amplitude, {r('max(r2)', 4)} AS best_r2, count(*) AS sectors FROM {fit.fit_decay_sql(bins_sql('sector', _sectors, 20), ['sector'])} f")
def sector_anisotropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = binned(spark, sf_dir).withColumn("sector", F.expr(geo.sector(AZ)))
    f = fit.fit_decay(finalise(accumulate(b, ["sector"]), 20), ["sector"])
    return f.agg(F.expr(r("avg(amplitude)", 4)).alias("mean_amplitude"), F.expr(r("stddev_pop(amplitude)", 4)).alias("sd_amplitude"), F.expr(r("max(r2)", 4)).alias("best_r2"), F.count("*").alias("sectors"))


_moments = {"monopole": "avg(theta)", "dipole_x": "avg(theta * sin(t) * cos(p))", "dipole_y": "avg(theta * sin(t) * sin(p))", "dipole_z": "avg(theta * cos(t))", "quadrupole": "stddev_pop(theta) / avg(theta)", "sectors": "count(*)"}


_moment = lambda k: k if k == "sectors" else r(k, 1)
_tb, _pb = f"cast(floor(round((90 - {geo.elevation('lat_i', 'lon_i', 'lat_j', 'lon_j')}) / 30, 9)) AS int)", f"cast(floor({AZ} / 45) AS int)"
_grid = f"(SELECT *, {_tb} AS tb, {_pb} AS pb FROM {BINNED} q)"
_cells = f"(SELECT theta, radians(tb * 30 + 15) AS t, radians(pb * 45 + 22.5) AS p FROM {fit.fit_decay_sql(bins_sql('tb, pb', _grid, 10), ['tb', 'pb'])} f WHERE amplitude > 0.0001)"


@query(f"SELECT {', '.join(f'{_moment(k)} AS {k}' for k in _moments)}, {r('sqrt(dipole_x * dipole_x + dipole_y * dipole_y + dipole_z * dipole_z)', 1)} AS dipole FROM (SELECT {', '.join(f'{v} AS {k}' for k, v in _moments.items())} FROM {_cells} c) m")
def sector_grid_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decay lengths on a colatitude x azimuth grid of pair directions, and their moments over the cells that decay."""
    b = binned(spark, sf_dir).selectExpr("*", f"{_tb} AS tb", f"{_pb} AS pb")
    f = fit.fit_decay(finalise(accumulate(b, ["tb", "pb"]), 10), ["tb", "pb"]).where("amplitude > 0.0001").selectExpr("*", "radians(tb * 30 + 15) AS t", "radians(pb * 45 + 22.5) AS p")
    m = f.agg(*[F.expr(v).alias(k) for k, v in _moments.items()])
    return select(m, {**{k: _moment(k) for k in _moments}, "dipole": r("sqrt(dipole_x * dipole_x + dipole_y * dipole_y + dipole_z * dipole_z)", 1)})


@query(f"SELECT a.center, wavelength, {r('a.amplitude', 5)} AS amplitude, {r('a.level', 5)} AS level, {r('a.r2', 4)} AS wave_r2, b.r2 AS exponential_r2, b.theta FROM {fit.fit_wave_sql(bins_sql('center'), ['center'])} a JOIN ({fits_text(['center'], bins_sql('center'))}) b ON a.center = b.center")
def plane_wave_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damped plane wave against the exponential, by weighted R2."""
    b = bins(spark, sf_dir, ["center"])
    wave = select(fit.fit_wave(b, ["center"]), {"center": "center", "wavelength": "wavelength", "amplitude": r("amplitude", 5), "level": r("level", 5), "wave_r2": r("r2", 4)})
    return wave.join(fits_of(fit.fit_decay(b, ["center"]), ["center"]).select("center", F.col("r2").alias("exponential_r2"), "theta"), "center")


_strata = "(CASE WHEN (h_i + h_j) / 2 < 800 THEN 0 WHEN (h_i + h_j) / 2 < 1600 THEN 1 ELSE 2 END) * 3 + (CASE WHEN abs(gm_i + gm_j) / 2 < 20 THEN 0 WHEN abs(gm_i + gm_j) / 2 < 40 THEN 1 ELSE 2 END)"


@query(f"SELECT {_text(['stratum'])} FROM {fit.fit_decay_sql(bins_sql('stratum', f'(SELECT *, {_strata} AS stratum FROM {BINNED} q)', 20), ['stratum'])} f")
def height_latitude_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = binned(spark, sf_dir).withColumn("stratum", F.expr(_strata))
    return _out(fit.fit_decay(finalise(accumulate(b, ["stratum"]), 20), ["stratum"]), ["stratum"])


@query(f"SELECT center, quintile, count(*) AS n, {r('avg(h)', 3)} AS mean_height, {r('avg(coherence)')} AS mean_coherence FROM (SELECT center, coherence, (h_i + h_j) / 2 AS h, ntile(5) OVER (PARTITION BY center ORDER BY (h_i + h_j) / 2, row) AS quintile FROM {PAIR_DAY_SQL} p) q GROUP BY center, quintile")
def height_quintiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifths of each centre's rows by mean height of the pair; ntile over a distributed rank."""
    ranked = cut(shuffled_rank(pair_day(spark, sf_dir).selectExpr("center", "coherence", "(h_i + h_j) / 2 AS h", "row"), ["center", "h", "row"], "k"))
    sizes = ranked.groupBy("center").agg(F.min("k").alias("first"), F.count("*").alias("m"))  # one row a centre
    placed = ranked.join(F.broadcast(sizes), "center").selectExpr("center", "coherence", "h", "k - first AS k", "m % 5 AS big", "m div 5 AS size")
    fifth = F.expr("cast(CASE WHEN k < big * (size + 1) THEN k div (size + 1) ELSE (k - big * (size + 1)) div greatest(size, 1) + big END AS int) + 1")
    return placed.groupBy("center", fifth.alias("quintile")).agg(F.count("*").alias("n"), F.expr(r("avg(h)", 3)).alias("mean_height"), F.expr(r("avg(coherence)")).alias("mean_coherence"))


_season_key = "CASE WHEN month(date) IN (12, 1, 2) THEN 'DJF' WHEN month(date) <= 5 THEN 'MAM' WHEN month(date) <= 8 THEN 'JJA' ELSE 'SON' END"
_compass = geo.compass_class(AZ)


@query(f"SELECT {_text(['season', 'compass'])} FROM {fit.fit_decay_sql(bins_sql('season, compass', f'(SELECT *, {_season_key} AS season, {_compass} AS compass FROM {BINNED} q)', 20), ['season', 'compass'])} f")
def seasonal_directional_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = binned(spark, sf_dir).selectExpr("*", f"{_season_key} AS season", f"{_compass} AS compass")
    return _out(fit.fit_decay(finalise(accumulate(b, ["season", "compass"]), 20), ["season", "compass"]), ["season", "compass"])


_ONE = f"(SELECT *, 1 AS one FROM {bins_sql('center')} z)"


@query(f"SELECT {_text(['center'])} FROM {fit.fit_decay_sql(_ONE, ['center'], w='one')} f")
def equal_weight_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(fit.fit_decay(bins(spark, sf_dir, ["center"]).withColumn("one", F.lit(1)), ["center"], w="one"), ["center"])


_single = f"(SELECT *, 1 AS one FROM {BINNED} q WHERE bin BETWEEN 0 AND 39)"


@query(fits_text(["center"], _single, r="dist_km", y="coherence", w="one"))
def pairwise_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on single rows instead of bins: the sums distribute, so no sample is needed; rows of one distance are summed first."""
    p = binned(spark, sf_dir).withColumn("one", F.lit(1))
    return fits_of(fit.fit_decay(p, ["center"], r="dist_km", y="coherence", w="one", together=False), ["center"])


_kappa = geo.kappa_from_mean_cosine("least(abs(mean_coherence), 0.999D)")
_in_kappa = f"(SELECT *, {_kappa} AS kappa FROM {bins_sql('center')} z)"


@query(f"SELECT a.center, a.theta AS theta_cosine, a.r2 AS r2_cosine, b.theta AS theta_kappa, b.r2 AS r2_kappa FROM ({fits_text(['center'], bins_sql('center'))}) a JOIN ({fits_text(['center'], _in_kappa, y='kappa')}) b ON a.center = b.center")
def concentration_space_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decay of the concentration parameter beside the decay of the mean cosine."""
    b = bins(spark, sf_dir, ["center"]).withColumn("kappa", F.expr(_kappa))
    a = fits_of(fit.fit_decay(b, ["center"]), ["center"]).select("center", F.col("theta").alias("theta_cosine"), F.col("r2").alias("r2_cosine"))
    return a.join(fits_of(fit.fit_decay(b, ["center"], y="kappa"), ["center"]).select("center", F.col("theta").alias("theta_kappa"), F.col("r2").alias("r2_kappa")), "center")


@query(f"SELECT b.center, b.bin, {r('b.mean_coherence', 5)} AS mean_coherence, {r('f.amplitude * exp(-b.distance_km / f.theta) + f.offset_c', 4)} AS predicted, {r('b.mean_coherence - (f.amplitude * exp(-b.distance_km / f.theta) + f.offset_c)', 4)} AS residual FROM {bins_sql('center')} b JOIN {fit.fit_decay_sql(bins_sql('center'), ['center'])} f ON f.center = b.center WHERE b.distance_km BETWEEN 100 AND 5000")
def bin_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bins(spark, sf_dir, ["center"])
    f = fit.fit_decay(b, ["center"]).select("center", "theta", "amplitude", "offset_c")
    p = "amplitude * exp(-distance_km / theta) + offset_c"
    return select(b.join(f, "center").where("distance_km BETWEEN 100 AND 5000"), {"center": "center", "bin": "bin", "mean_coherence": r("mean_coherence", 5), "predicted": r(p, 4), "residual": r(f"mean_coherence - ({p})", 4)})


@query(f"SELECT macro, count(*) AS bins, cast(sum(n) AS bigint) AS n, {r('sum(s1) / sum(n)', 5)} AS mean_coherence, {r('sum(sd) / sum(n)', 3)} AS distance_km FROM (SELECT *, cast(floor((sum(n) OVER (ORDER BY bin) - n) / ((sum(n) OVER ()) / 10.0)) AS int) AS macro FROM (SELECT bin, sum(s1) AS s1, sum(sd) AS sd, sum(n) AS n FROM {STATES} s GROUP BY bin) t) u GROUP BY macro")
def equal_count_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro bins of about a tenth of the rows each, by the count before a bin."""
    s = accumulate(binned(spark, sf_dir), []).withColumn("one", F.lit(1))  # at most 40 rows
    w = Window.partitionBy("one")
    macro = F.floor((F.sum("n").over(w.orderBy("bin")) - F.col("n")) / (F.sum("n").over(w) / 10.0)).cast("int")
    return s.withColumn("macro", macro).groupBy("macro").agg(F.count("*").alias("bins"), F.sum("n").alias("n"), F.expr(r("sum(s1) / sum(n)", 5)).alias("mean_coherence"), F.expr(r("sum(sd) / sum(n)", 3)).alias("distance_km"))


_eighth = geo.cycle_phase("dd", 433.0)
_phased = {"phase_bin": f"cast(floor(round({_eighth}, 9) / (2 * pi()) * 8) AS int)", "compass": _compass}
_dd = "(SELECT *, date_diff('day', date '2000-01-01', date) AS dd FROM " + BINNED + " q)"
_cycle = f"(SELECT *, {', '.join(f'{v} AS {k}' for k, v in _phased.items())} FROM {_dd} z)"
_ratio = {"phase_bin": "phase_bin", "ew": r("ew", 1), "ns": r("ns", 1), "ratio": r("ew / ns", 3)}


@query(f"SELECT {', '.join(f'{v} AS {k}' for k, v in _ratio.items())} FROM (SELECT phase_bin, max(CASE WHEN compass = 'EW' THEN theta END) AS ew, max(CASE WHEN compass = 'NS' THEN theta END) AS ns FROM {fit.fit_decay_sql(bins_sql('phase_bin, compass', _cycle, 20), ['phase_bin', 'compass'])} f WHERE amplitude > 0.0001 GROUP BY 1) s")
def phase_decay_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """East-west over north-south decay length in eight phases of a long cycle, where both decay."""
    b = binned(spark, sf_dir).withColumn("dd", F.datediff("date", F.lit("2000-01-01").cast("date")))
    for k, x in _phased.items():
        b = b.withColumn(k, F.expr(x))
    f = fit.fit_decay(finalise(accumulate(b, ["phase_bin", "compass"]), 20), ["phase_bin", "compass"]).where("amplitude > 0.0001")
    return select(f.groupBy("phase_bin").agg(F.expr("max(CASE WHEN compass = 'EW' THEN theta END)").alias("ew"), F.expr("max(CASE WHEN compass = 'NS' THEN theta END)").alias("ns")), _ratio)
