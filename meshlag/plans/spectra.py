"""Cross-spectra of station pairs and what follows from them: SP1-SP14, J10, C20, C24, A27."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlag.functions import geo
from meshlag.operators import fit, spectral
from meshlag.plans.fixtures import STATION_SQL, clock, clock_sql, read, station
from meshlag.plans.registry import query, r, select

SECONDS, BLOCK, SIZE, BANDS = 21_600, 40, 16, [1, 2, 3, 4]


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clock series cut into blocks of 40 epochs."""
    return clock(spark, sf_dir, SECONDS).withColumn("blk", F.floor(F.col("e") / BLOCK).cast("long"))


SERIES = f"""(SELECT blk, st, e, idx, n, bias - coalesce(regr_slope(bias, idx) OVER w * idx + regr_intercept(bias, idx) OVER w, 0) AS x FROM (
    SELECT blk, st, e, bias, cast(row_number() OVER (PARTITION BY blk, st ORDER BY e) - 1 AS double) AS idx, count(*) OVER (PARTITION BY blk, st) AS n FROM (SELECT *, cast(floor(e / {BLOCK}.0) AS bigint) AS blk FROM {clock_sql(SECONDS)} c) q) z WINDOW w AS (PARTITION BY blk, st))"""
SPEC = f"""(SELECT blk, st, seg, k, sum(tp * cs * x) - avg(x) * sum(tp * cs) AS re, -(sum(tp * sn * x) - avg(x) * sum(tp * sn)) AS im FROM (
    SELECT s.blk, s.st, g.seg, k.k, s.x, 0.5 - 0.5 * cos(2 * pi() * (s.idx - g.seg * {SIZE // 2}) / {SIZE}) AS tp, cos(2 * pi() * k.k * (s.idx - g.seg * {SIZE // 2}) / {SIZE}) AS cs, sin(2 * pi() * k.k * (s.idx - g.seg * {SIZE // 2}) / {SIZE}) AS sn
    FROM {SERIES} s JOIN range(0, {BLOCK // (SIZE // 2)}) g(seg) ON s.idx >= g.seg * {SIZE // 2} AND s.idx < g.seg * {SIZE // 2} + {SIZE} AND g.seg * {SIZE // 2} + {SIZE} <= s.n, range(1, {len(BANDS) + 1}) k(k)) q GROUP BY 1, 2, 3, 4)"""
CROSS = f"(SELECT a.blk, a.st AS i, b.st AS j, a.k, sum(a.re * b.re + a.im * b.im) AS sre, sum(a.re * b.im - a.im * b.re) AS sim, sum(a.re * a.re + a.im * a.im) AS pxx, sum(b.re * b.re + b.im * b.im) AS pyy FROM {SPEC} a JOIN {SPEC} b ON a.blk = b.blk AND a.seg = b.seg AND a.k = b.k AND a.st < b.st GROUP BY 1, 2, 3, 4)"


def cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spectral.detrended(blocks(spark, sf_dir), ["blk", "st"])
    return spectral.cross(spectral.spectra(s, ["blk", "st"], SIZE, BANDS), ["blk"])


@query(f"SELECT blk, st, e, {r('x', 5)} AS x FROM {SERIES} s")
def detrended_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(spectral.detrended(blocks(spark, sf_dir), ["blk", "st"]), {"blk": "blk", "st": "st", "e": "e", "x": r("x", 5)})


@query(f"SELECT blk, st, seg, k, {r('re', 4)} AS re, {r('im', 4)} AS im FROM {SPEC} s")
def station_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spectral.detrended(blocks(spark, sf_dir), ["blk", "st"])
    return select(spectral.spectra(s, ["blk", "st"], SIZE, BANDS), {"blk": "blk", "st": "st", "seg": "seg", "k": "k", "re": r("re", 4), "im": r("im", 4)})


_pm = {"phase": r("atan2(sum(sim), sum(sre))", 4), "magnitude": r("avg(sqrt(sre * sre + sim * sim))", 2), "real_coherency": r("avg(CASE WHEN pxx * pyy > 0 THEN sre / sqrt(pxx * pyy) END)", 5), "imag_coherency": r("avg(CASE WHEN pxx * pyy > 0 THEN abs(sim) / sqrt(pxx * pyy) END)", 5), "pli": r("abs(avg(sign(sim)))", 5), "wpli": r("CASE WHEN sum(abs(sim)) > 0 THEN abs(sum(sim)) / sum(abs(sim)) END", 5)}


@query(f"SELECT blk, i, j, {', '.join(f'{v} AS {k}' for k, v in _pm.items())} FROM {CROSS} c GROUP BY blk, i, j")
def pair_spectral_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spectral.pair_measures(cross(spark, sf_dir), ["blk"])
    digits = {"phase": 4, "magnitude": 2}
    return select(m, {"blk": "blk", "i": "i", "j": "j", **{k: r(k, digits.get(k, 5)) for k in _pm}})


@query(f"SELECT blk, i, j, {r('cos(atan2(sim, sre))', 4)} AS cos_phase, {r('sqrt(sre * sre + sim * sim)', 2)} AS magnitude, {r('sre', 2)} AS weighted_cosine FROM {CROSS} c WHERE k = 1")
def first_bin_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(cross(spark, sf_dir).where("k = 1"), {"blk": "blk", "i": "i", "j": "j", "cos_phase": r("cos(atan2(sim, sre))", 4), "magnitude": r("sqrt(sre * sre + sim * sim)", 2), "weighted_cosine": r("sre", 2)})


#: Both coordinates of the phase, so that it may lie anywhere on the circle.
PHASED = {"n_epochs": "n_epochs", "cos_phase": r("cos(phase)", 4), "sin_phase": r("sin(phase)", 4), "magnitude": r("magnitude", 2)}
_hourly = f"(SELECT *, cast(floor(e / 240.0) AS bigint) AS blk FROM {clock_sql(3600)} h)"


@query(f"SELECT blk, i, j, {', '.join(f'{v} AS {k}' for k, v in PHASED.items())} FROM {spectral.common_phases_sql(_hourly, 'blk', 32, [1, 2, 3, 4], 32)} p")
def pair_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly series with gaps: pairs with equal epochs by station spectra, the rest on their common epochs."""
    obs = clock(spark, sf_dir, 3600).withColumn("blk", F.floor(F.col("e") / 240).cast("long"))
    return select(spectral.phases(obs, ["blk"], 32, [1, 2, 3, 4], 32), {"blk": "blk", "i": "i", "j": "j", **PHASED})


def _class(a: str, b: str) -> str:
    return f"CASE WHEN {geo.great_circle(f'{a}.lat', f'{a}.lon', f'{b}.lat', f'{b}.lon')} <= 6000 THEN 'near' ELSE 'far' END"


_near = _class("sa", "sb")


METRICS = ("cos_phase", "imag_coherency", "pli", "wpli")
_measured = f"""(SELECT i, j, cos(atan2(sum(sim), sum(sre))) AS cos_phase, avg(CASE WHEN pxx * pyy > 0 THEN abs(sim) / sqrt(pxx * pyy) END) AS imag_coherency, abs(avg(sign(sim))) AS pli, CASE WHEN sum(abs(sim)) > 0 THEN abs(sum(sim)) / sum(abs(sim)) END AS wpli FROM {CROSS} c GROUP BY blk, i, j)"""
_measures = f"(SELECT metric, 1 AS one, {geo.great_circle('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS dist_km, CASE metric {' '.join(f'WHEN {chr(39)}{m}{chr(39)} THEN {m}' for m in METRICS)} END AS value FROM {_measured} p JOIN {STATION_SQL} a ON a.id = p.i JOIN {STATION_SQL} b ON b.id = p.j, (VALUES {', '.join(f'({chr(39)}{m}{chr(39)})' for m in METRICS)}) t(metric))"
_metric_fits = fit.fit_decay_sql(_measures, ["metric"], r="dist_km", y="value", w="one")
_verdict = {"metric": "metric", "amplitude": r("amplitude", 3), "r2": r("r2", 3), "robust_r2": r("robust_r2", 3), "zero_lag_suspect": "metric = 'cos_phase' AND r2 > 2 * robust_r2"}


@query(f"SELECT {', '.join(f'{v} AS {k}' for k, v in _verdict.items())} FROM (SELECT *, max(CASE WHEN metric <> 'cos_phase' THEN r2 END) OVER () AS robust_r2 FROM {_metric_fits} f) s")
def zero_lag_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decay of each measure over distance: a signal that only the cosine shows is suspect of zero lag."""
    m = spectral.pair_measures(cross(spark, sf_dir), ["blk"]).withColumn("cos_phase", F.cos("phase"))
    s = station(spark, sf_dir)
    for e in "ij":
        m = m.join(s.select(F.col("id").alias(e), F.col("lat").alias(f"lat_{e}"), F.col("lon").alias(f"lon_{e}")), e)
    m = m.withColumn("dist_km", F.expr(geo.great_circle("lat_i", "lon_i", "lat_j", "lon_j")))
    long = m.select("dist_km", F.expr(f"stack({len(METRICS)}, {', '.join(f'{chr(39)}{n}{chr(39)}, {n}' for n in METRICS)}) AS (metric, value)")).withColumn("one", F.lit(1))
    fits = fit.fit_decay(long, ["metric"], r="dist_km", y="value", w="one")
    robust = fits.where("metric <> 'cos_phase'").agg(F.max("r2").alias("robust_r2"))
    return select(fits.join(F.broadcast(robust), F.lit(True)), _verdict)  # one row


_win = "(SELECT st, w, avg(value) AS m, stddev_samp(value) AS sd, count(*) AS n FROM (SELECT user_id % 8 AS st, value, unnest([cast(floor(epoch_us(ts) / 3600000000) AS bigint), cast(floor(epoch_us(ts) / 3600000000) AS bigint) - 1]) AS w FROM events) q GROUP BY 1, 2)"


@query(f"SELECT st, w, {r('m')} AS mean_value, {r('sd')} AS sd, n FROM {_win} z WHERE n >= 3")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-hour windows each hour; w is the hour in which a window starts."""
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("st"), F.col("ts").cast("timestamp").alias("ts"), "value")
    g = e.groupBy("st", F.window("ts", "2 hours", "1 hour")).agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"), F.count("*").alias("n")).where("n >= 3")
    return select(g.withColumn("w", F.unix_seconds(F.col("window.start")) / 3600), {"st": "st", "w": "cast(w AS bigint)", "mean_value": r("m"), "sd": r("sd"), "n": "n"})


_sliding = f"(SELECT st, e, bias, unnest([cast(floor(e / 24.0) AS bigint), cast(floor(e / 24.0) AS bigint) - 1]) AS blk FROM {clock_sql(3600)} h)"


@query(f"SELECT blk, i, j, {', '.join(f'{v} AS {k}' for k, v in PHASED.items())} FROM {spectral.common_phases_sql(_sliding, 'blk', 16, [1, 2, 3], 24)} p")
def windowed_pair_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding blocks of 48 hours each 24: pair phase in each window."""
    obs = clock(spark, sf_dir, 3600).withColumn("blk", F.explode(F.array(F.floor(F.col("e") / 24).cast("long"), (F.floor(F.col("e") / 24) - 1).cast("long"))))
    return select(spectral.phases(obs, ["blk"], 16, [1, 2, 3], 24), {"blk": "blk", "i": "i", "j": "j", **PHASED})


_sim = "1 / (1 + abs(a.m - b.m) / 100)"


@query(f"SELECT a.w, {_near} AS class, count(*) AS pairs, {r(f'avg({_sim})')} AS similarity FROM {_win} a JOIN {_win} b ON a.w = b.w AND a.st < b.st JOIN {STATION_SQL} sa ON sa.id = a.st JOIN {STATION_SQL} sb ON sb.id = b.st GROUP BY 1, 2")
def instant_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of station means at one instant, by class of distance: averages first, then pairs."""
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("st"), F.col("ts").cast("timestamp").alias("ts"), "value")
    m = e.groupBy("st", F.window("ts", "2 hours", "1 hour")).agg(F.avg("value").alias("m")).select("st", (F.unix_seconds(F.col("window.start")) / 3600).cast("long").alias("w"), "m").join(station(spark, sf_dir).select(F.col("id").alias("st"), "lat", "lon"), "st")
    p = m.alias("a").join(m.alias("b"), "w").where("a.st < b.st")
    return p.select("w", F.expr(_class("a", "b")).alias("class"), F.expr(_sim).alias("s")).groupBy("w", "class").agg(F.count("*").alias("pairs"), F.expr(r("avg(s)")).alias("similarity"))


@query(f"SELECT class, count(*) AS windows, {r('avg(similarity)', 5)} AS mean_of_means FROM (SELECT a.w, {_near} AS class, round(avg({_sim}), 6) AS similarity FROM {_win} a JOIN {_win} b ON a.w = b.w AND a.st < b.st JOIN {STATION_SQL} sa ON sa.id = a.st JOIN {STATION_SQL} sb ON sb.id = b.st GROUP BY 1, 2) q GROUP BY 1")
def two_level_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlag.plans.registry import QUERIES

    s = QUERIES["instant_similarity"](spark, sf_dir)
    return s.groupBy("class").agg(F.count("*").alias("windows"), F.expr(r("avg(similarity)", 5)).alias("mean_of_means"))


@query(f"""SELECT season, local_hour, count(*) AS n, {r('avg(v)')} AS mean_value, {r('stddev_samp(v)')} AS sd FROM (
    SELECT {geo.season('m')} AS season, cast(floor(round({geo.local_hour('h', 'lon')}, 6)) AS int) % 24 AS local_hour, v FROM (
        SELECT month(ts) AS m, hour(ts) AS h, s.lon, cos(value) AS v FROM events e JOIN {STATION_SQL} s ON s.id = e.user_id % 40) q) z GROUP BY 1, 2""")
def diurnal_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").selectExpr("user_id % 40 AS id", "month(ts) AS m", "hour(ts) AS h", "cos(value) AS v").join(station(spark, sf_dir).select("id", "lon"), "id")
    k = e.selectExpr(f"{geo.season('m')} AS season", f"cast(floor(round({geo.local_hour('h', 'lon')}, 6)) AS int) % 24 AS local_hour", "v")
    return k.groupBy("season", "local_hour").agg(F.count("*").alias("n"), F.expr(r("avg(v)")).alias("mean_value"), F.expr(r("stddev_samp(v)")).alias("sd"))


@query()
def diurnal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day to night ratio, relative deviation over hours and the peak hour of each season."""
    from meshlag.plans.registry import QUERIES

    p = QUERIES["diurnal_profile"](spark, sf_dir)
    day = F.col("local_hour").between(6, 17)
    return p.groupBy("season").agg((F.avg(F.when(day, F.col("mean_value"))) / F.avg(F.when(~day, F.col("mean_value")))).alias("day_night"), (F.stddev_pop("mean_value") / F.abs(F.avg("mean_value"))).alias("cv"), F.max_by("local_hour", F.struct("mean_value", "local_hour")).alias("peak_hour"))
