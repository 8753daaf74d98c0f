"""Daily series against external series: A10, A13-A16, J7, SP16-SP20, SP22-SP26, W2-W10, C21, C23."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlag.config import DEFAULT
from meshlag.operators import series
from meshlag.operators.stats import p_of_r
from meshlag.plans.fixtures import DAILY_SQL, EXTERNAL_SQL, PAIR_DAY_SQL, daily, external_daily, pair_day
from meshlag.plans.registry import query, r, select

_d0 = "date_diff('day', date '1995-01-01', date)"


def by_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(center, t, m): daily mean coherence of each centre, t in days."""
    p = pair_day(spark, sf_dir, False)
    return p.groupBy("center", F.datediff("date", F.lit("1995-01-01").cast("date")).alias("t")).agg(F.avg("coherence").alias("m"))


BY_CENTER = f"(SELECT center, {_d0} AS t, avg(coherence) AS m FROM {PAIR_DAY_SQL} p GROUP BY 1, 2)"


@query(f"SELECT date, {r('avg(coherence)')} AS coherence_mean, {r('median(coherence)', 5)} AS coherence_median, {r('stddev_pop(coherence)')} AS coherence_std, count(*) AS coherence_count FROM {PAIR_DAY_SQL} p GROUP BY date")
def daily_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair_day(spark, sf_dir, False)
    return p.groupBy("date").agg(F.expr(r("avg(coherence)")).alias("coherence_mean"), F.expr(r("percentile(coherence, 0.5)", 5)).alias("coherence_median"), F.expr(r("stddev_pop(coherence)")).alias("coherence_std"), F.count("*").alias("coherence_count"))


_ext = {"days": "count(*)", "r_kp": r("corr(m, kp_index)", 5), "r_f107": r("corr(m, f107_flux)", 5), "r_sd_kp": r("corr(sd, kp_index)", 5), "slope_kp": r("regr_slope(m, kp_index)")}


@query(f"SELECT {', '.join(f'{v} AS {k}' for k, v in _ext.items())} FROM {DAILY_SQL} d JOIN {EXTERNAL_SQL} x ON x.date = d.date")
def external_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(spark, sf_dir).join(external_daily(spark, sf_dir), "date").agg(*[F.expr(v).alias(k) for k, v in _ext.items()])


@query()
def external_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations by year with their two-sided p-values."""
    d = daily(spark, sf_dir).join(external_daily(spark, sf_dir), "date").groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n"), F.corr("m", "kp_index").alias("r"))
    return d.withColumn("p_value", p_of_r("r", F.col("n").cast("double")))


_sg = series.savgol_weights(31, 3)


@query(f"SELECT center, t, {r('CASE WHEN full_ THEN v END', 5)} AS smooth FROM (SELECT center, t, " + " + ".join(f"({w!r}) * {'lag' if k < 15 else 'lead'}(m, {abs(15 - k)}) OVER w" for k, w in enumerate(_sg)) + f" AS v, lag(m, 15) OVER w IS NOT NULL AND lead(m, 15) OVER w IS NOT NULL AS full_ FROM {BY_CENTER} b WINDOW w AS (PARTITION BY center ORDER BY t)) q")
def savitzky_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series.smooth(by_center(spark, sf_dir), ["center"], "t", "m", _sg, "v", renormalise=False)
    w = Window.partitionBy("center").orderBy("t")
    s = s.withColumn("full_", F.lag("m", 15).over(w).isNotNull() & F.lead("m", 15).over(w).isNotNull())
    return select(s, {"center": "center", "t": "t", "smooth": r("CASE WHEN full_ THEN v END", 5)})


_z = "(SELECT center, t, (m - avg(m) OVER (PARTITION BY center)) / stddev_pop(m) OVER (PARTITION BY center) AS z FROM {b} b WHERE center = '{c}')"


@query(f"SELECT cast(y.t - x.t AS int) AS lag, {r('avg(x.z * y.z)', 5)} AS r, count(*) AS n FROM {_z.format(b=BY_CENTER, c='A')} x JOIN {_z.format(b=BY_CENTER, c='R')} y ON y.t BETWEEN x.t - 45 AND x.t + 45 GROUP BY 1")
def lag_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = by_center(spark, sf_dir)
    a, b = (s.where(F.col("center") == c).select(F.lit(1).alias("one"), "t", "m") for c in ("A", "R"))
    return select(series.cross_correlation(a, b, ["one"], "t", "m", 45), {"lag": "lag", "r": r("r", 5), "n": "n"})


@query(f"SELECT center, t, {r('phi', 5)} AS phi, {r('m - phi * l', 5)} AS white FROM (SELECT center, t, m, l, least(0.99, greatest(-0.99, corr(m, l) OVER (PARTITION BY center))) AS phi FROM (SELECT *, lag(m) OVER (PARTITION BY center ORDER BY t) AS l FROM {BY_CENTER} b) q) z")
def prewhitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(series.prewhiten(by_center(spark, sf_dir), ["center"], "t", "m"), {"center": "center", "t": "t", "phi": r("phi", 5), "white": r("white", 5)})


_g = "coalesce((hs * hs * a + hd * hd * b) / (hs * hd * (hd + hs)), a / hd, b / hs)"


@query(f"SELECT center, t, {r(_g)} AS gradient FROM (SELECT center, t, cast(t - lag(t) OVER w AS double) AS hs, cast(lead(t) OVER w - t AS double) AS hd, m - lag(m) OVER w AS b, lead(m) OVER w - m AS a FROM {BY_CENTER} c WINDOW w AS (PARTITION BY center ORDER BY t)) q")
def daily_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(series.gradient(by_center(spark, sf_dir), ["center"], "t", "m"), {"center": "center", "t": "t", "gradient": r("gradient")})


@query(f"SELECT center, t, {r('CASE WHEN c = 3 THEN med END')} AS median3 FROM (SELECT center, t, median(m) OVER w AS med, count(m) OVER w AS c FROM {BY_CENTER} b WINDOW w AS (PARTITION BY center ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) q")
def rolling_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(series.rolling_median(by_center(spark, sf_dir), ["center"], "t", "m", 1, "x"), {"center": "center", "t": "t", "median3": r("x")})


_gw = series.gaussian_weights(8, 3.0)
_term = [f"{'lag' if k < 8 else 'lead'}(m, {abs(8 - k)}) OVER w" for k in range(17)]


@query(f"SELECT center, t, {r('a / b', 5)} AS smooth FROM (SELECT center, t, " + " + ".join(f"coalesce({w!r} * {x}, 0)" for w, x in zip(_gw, _term, strict=True)) + " AS a, " + " + ".join(f"CASE WHEN {x} IS NULL THEN 0 ELSE {w!r} END" for w, x in zip(_gw, _term, strict=True)) + f" AS b FROM {BY_CENTER} c WINDOW w AS (PARTITION BY center ORDER BY t)) q")
def gaussian_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(series.smooth(by_center(spark, sf_dir), ["center"], "t", "m", _gw), {"center": "center", "t": "t", "smooth": r("smooth", 5)})


_q = {"n": "n", "a": "a", "b": "b", "c": "c"}
_poly = "sum(x) AS s1, sum(x*x) AS s2, sum(x*x*x) AS s3, sum(x*x*x*x) AS s4, sum(y) AS t0, sum(x*y) AS t1, sum(x*x*y) AS t2, cast(count(*) AS double) AS s0"
_det = "(s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2))"
_quad = "(t0 * (s1 * s3 - s2 * s2) - t1 * (s0 * s3 - s1 * s2) + t2 * (s0 * s2 - s1 * s1)) / " + _det


@query(f"SELECT center, {r(_quad, 6)} AS curvature FROM (SELECT center, {_poly} FROM (SELECT center, cast(t - 1250 AS double) / 1000 AS x, m AS y FROM {BY_CENTER} b) q GROUP BY center) z")
def quadratic_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = by_center(spark, sf_dir).selectExpr("center", "cast(t - 1250 AS double) / 1000 AS x", "m AS y")
    sums = s.groupBy("center").agg(*[F.expr(p.split(" AS ")[0]).alias(p.split(" AS ")[1].strip()) for p in _poly.rsplit(", cast", 1)[0].split(", ")], F.count("*").cast("double").alias("s0"))
    return select(sums, {"center": "center", "curvature": r(_quad, 6)})


@query(f"SELECT month, {r('quantile_cont(m, 0.1)')} AS p10, {r('quantile_cont(m, 0.9)')} AS p90, cast(sum(CASE WHEN m > hi THEN 1 ELSE 0 END) AS bigint) AS above FROM (SELECT month(date) AS month, m, (SELECT quantile_cont(m, 0.95) FROM {DAILY_SQL} z) AS hi FROM {DAILY_SQL} d) q GROUP BY month")
def daily_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir)
    hi = d.agg(F.percentile("m", 0.95).alias("hi"))
    j = d.join(F.broadcast(hi), F.lit(True)).withColumn("month", F.month("date"))  # one row
    return j.groupBy("month").agg(F.expr(r("percentile(m, 0.1)")).alias("p10"), F.expr(r("percentile(m, 0.9)")).alias("p90"), F.sum(F.when(F.col("m") > F.col("hi"), 1).otherwise(0)).alias("above"))


def _indexed(spark: SparkSession, sf_dir: str, days: int = 256) -> DataFrame:
    """The centres' series cut into spans of `days` days, with idx inside the span."""
    s = by_center(spark, sf_dir).withColumn("span", F.floor(F.col("t") / days).cast("int")).withColumn("idx", F.pmod("t", F.lit(days)))
    w = Window.partitionBy("center", "span")
    return s.withColumn("x", F.col("m") - F.avg("m").over(w)).withColumn("n", F.lit(days))


_mt = 5
_freqs = 40


@query(f"""SELECT center, span, k, {r('avg(re * re + im * im)', 5)} AS power FROM (
    SELECT center, span, k, tp, sum(h * x * cos(a)) AS re, sum(h * x * sin(a)) AS im FROM (
        SELECT center, span, k, tp, x, sqrt(2.0 / 257) * sin(pi() * tp * (idx + 1) / 257) AS h, pi() * k * idx / 256 AS a FROM (
            SELECT center, cast(floor(t / 256) AS int) AS span, t % 256 AS idx, m - avg(m) OVER (PARTITION BY center, floor(t / 256)) AS x FROM {BY_CENTER} b) s, range(1, {_mt + 1}) t1(tp), range(1, {_freqs + 1}) t2(k)) q GROUP BY 1, 2, 3, 4) z GROUP BY 1, 2, 3""")
def multitaper_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    psd = series.multitaper_psd(_indexed(spark, sf_dir), ["center", "span"], "idx", "x", "n", _mt, _freqs)
    return select(psd, {"center": "center", "span": "span", "k": "k", "power": r("power", 5)})


@query()
def spectral_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local signal-to-noise ratio of each line and the theoretical AR(1) level."""
    psd = series.multitaper_psd(_indexed(spark, sf_dir), ["center", "span"], "idx", "x", "n", _mt, _freqs)
    white = series.prewhiten(by_center(spark, sf_dir), ["center"], "t", "m").groupBy("center").agg(F.first("phi").alias("phi"), F.var_pop("white").alias("variance"))
    return series.local_snr(psd, ["center", "span"]).join(white, "center").withColumn("ar1", series.ar1_spectrum(F.col("k") / 512, F.col("phi"), F.col("variance")))


_scales = (10.0, 20.0, 40.0)
LONG_SCALES = tuple(float(s) for s in range(20, 201, 20))


@query(f"""SELECT center, scale, t, {r('re * re + im * im', 5)} AS power FROM (
    SELECT b.center, s.scale, c.t, sum(b.m * exp(-0.5 * pow((c.t - b.t) / s.scale, 2)) * pow(pi(), -0.25) / sqrt(s.scale) * cos(6 * (c.t - b.t) / s.scale)) AS re,
           sum(b.m * exp(-0.5 * pow((c.t - b.t) / s.scale, 2)) * pow(pi(), -0.25) / sqrt(s.scale) * sin(6 * (c.t - b.t) / s.scale)) AS im
    FROM {BY_CENTER} b, (VALUES (10.0::double), (20.0), (40.0)) s(scale), {BY_CENTER} c WHERE c.center = b.center AND abs(c.t - b.t) <= floor(s.scale * 4) GROUP BY 1, 2, 3) q""")
def wavelet_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(series.morlet_power(by_center(spark, sf_dir), ["center"], "t", "m", list(_scales)), {"center": "center", "scale": "scale", "t": "t", "power": r("power", 5)})


_morlet = f"""(SELECT b.center, s.scale, c.t, sum(b.m * exp(-0.5 * pow((c.t - b.t) / s.scale, 2)) * pow(pi(), -0.25) / sqrt(s.scale) * cos(6 * (c.t - b.t) / s.scale)) AS re,
        sum(b.m * exp(-0.5 * pow((c.t - b.t) / s.scale, 2)) * pow(pi(), -0.25) / sqrt(s.scale) * sin(6 * (c.t - b.t) / s.scale)) AS im
    FROM {BY_CENTER} b, (VALUES {', '.join(f'({s!r}::double)' for s in LONG_SCALES)}) s(scale), {BY_CENTER} c WHERE c.center = b.center AND abs(c.t - b.t) <= floor(s.scale * 4) GROUP BY 1, 2, 3)"""
MORLET = f"(SELECT center, scale, t, re * re + im * im AS power FROM {_morlet} q)"


@query(f"SELECT center, scale, t, {r('power', 5)} AS power FROM {MORLET} m")
def wavelet_spectrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wavelet power of every centre and day at scales of 20 to 200 days; `wavelet_power` is its short part with a SQL twin."""
    return select(series.morlet_by_series(by_center(spark, sf_dir), ["center"], "t", "m", list(LONG_SCALES)), {"center": "center", "scale": "scale", "t": "t", "power": r("power", 5)})


#: Fourier period of a Morlet scale for omega 6.
_period = "scale * 4 * pi() / (6 + sqrt(38.0D))"
TARGETS = (27.3, 121.75, 182.6)
_targets = ", ".join(f"({p!r}::double)" for p in TARGETS)


@query(f"SELECT center, t, target, {r('avg(power)', 5)} AS band_power FROM (SELECT *, {_period} AS period FROM {MORLET} m) q, (VALUES {_targets}) v(target) WHERE abs(period - target) <= 0.2 * target GROUP BY 1, 2, 3")
def band_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean wavelet power of each day in bands of a fifth around three periods."""
    m = series.morlet_by_series(by_center(spark, sf_dir), ["center"], "t", "m", list(LONG_SCALES)).withColumn("period", F.expr(_period))
    return series.band_power(m, ["center", "t"], "period", "power", TARGETS).select("center", "t", "target", F.expr(r("band_power", 5)).alias("band_power"))


_peaked = f"(SELECT *, first_value(k) OVER (PARTITION BY center, t ORDER BY power DESC, k) AS top FROM (SELECT *, {_period} AS period, row_number() OVER (PARTITION BY center, t ORDER BY scale) AS k FROM {MORLET} m) q)"
_edge = "least(t - min(t) OVER (PARTITION BY center), max(t) OVER (PARTITION BY center) - t) / sqrt(2.0D)"


@query(f"SELECT center, t, {r('p', 3)} AS peak_period, {r(_edge, 3)} AS cone FROM (SELECT center, t, sum(period * power) / sum(power) AS p FROM {_peaked} z WHERE abs(k - top) <= 3 GROUP BY 1, 2) y")
def stable_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power-weighted period around each day's strongest scale, and the longest period the ends of the series don't reach."""
    m = series.morlet_by_series(by_center(spark, sf_dir), ["center"], "t", "m", list(LONG_SCALES)).withColumn("period", F.expr(_period))
    peaks = series.stable_peak(m, ["center", "t"], "period", "power", 3)
    return select(peaks, {"center": "center", "t": "t", "peak_period": r("peak_period", 3), "cone": r(_edge, 3)})


LINES = (365.25, 182.6, 121.75, 27.3, 13.7)
_n = f"(SELECT center, m AS y, row_number() OVER (PARTITION BY center ORDER BY t) - 1 AS idx, count(*) OVER (PARTITION BY center) AS n FROM {BY_CENTER} b)"
_block = DEFAULT.spectral_block
_drawn = f"""(SELECT c.center, p.replicate, c.n, p.b * {_block} + o.o AS idx, cast('0x' || substr(md5(c.center || '#' || p.replicate || '#' || p.b), 1, 8) AS bigint) % (c.n - {_block} + 1) + o.o AS src
    FROM (SELECT DISTINCT center, n FROM {_n} s) c, (SELECT r AS replicate, b FROM range(1, {DEFAULT.spectral_replicates + 1}) x(r), range(0, 400) y(b)) p, range(0, {_block}) o(o) WHERE p.b * {_block} + o.o < c.n)"""
_both = f"(SELECT center, 0 AS replicate, idx, n, y FROM {_n} s UNION ALL SELECT d.center, d.replicate, d.idx, d.n, s.y FROM {_drawn} d JOIN {_n} s ON s.center = d.center AND s.idx = d.src)"
_tapered = f"(SELECT center, replicate, line, tp, y, n, sqrt(2.0 / (n + 1)) * sin(pi() * tp * (idx + 1) / (n + 1)) AS h, 2 * pi() * idx / line AS a FROM {_both} q, range(1, {_mt + 1}) t1(tp), (VALUES {', '.join(f'({x!r}::double)' for x in LINES)}) t2(line))"
_powers = f"(SELECT center, replicate, line, avg(re * re + im * im) AS power FROM (SELECT center, replicate, line, tp, sum(h * y * cos(a)) - avg(y) * sum(h * cos(a)) AS re, sum(h * y * sin(a)) - avg(y) * sum(h * sin(a)) AS im FROM {_tapered} z GROUP BY 1, 2, 3, 4) x GROUP BY 1, 2, 3)"


@query(f"SELECT a.center, a.line AS period, {r('b.power', 5)} AS power, {r('(cast(sum(CASE WHEN a.power >= b.power THEN 1 ELSE 0 END) AS double) + 1) / (count(*) + 1)', 5)} AS p_value FROM {_powers} a JOIN {_powers} b ON a.center = b.center AND a.line = b.line AND b.replicate = 0 WHERE a.replicate > 0 GROUP BY a.center, a.line, b.power")
def spectral_line_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p of the multitaper power at five periods against a moving-block bootstrap of the series."""
    w = Window.partitionBy("center")
    s = by_center(spark, sf_dir).select("center", F.col("m").alias("y"), (F.row_number().over(w.orderBy("t")) - 1).alias("idx"), F.count("*").over(w).alias("n"))
    p = series.block_bootstrap_p(s, ["center"], "idx", "y", "n", LINES, _mt, _block, DEFAULT.spectral_replicates)
    return select(p, {"center": "center", "period": "line", "power": r("power", 5), "p_value": r("p_value", 5)})


@query()
def on_off_days(spark: SparkSession, sf_dir: str, surrogates: int = DEFAULT.surrogates) -> DataFrame:
    """Days whose power, averaged over 20 to 200 days, exceeds the 95th percentile of AR(1) surrogates' daily power."""
    s = by_center(spark, sf_dir)
    daily_power = lambda df, keys, y: series.morlet_by_series(df, keys, "t", y, list(LONG_SCALES)).groupBy(*keys, "t").agg(F.avg("power").alias("power"))
    power = daily_power(s, ["center"], "m")
    sur = series.ar1_surrogates(s, ["center"], "t", "m", surrogates)
    level = daily_power(sur, ["center", "surrogate"], "value").groupBy("center").agg(F.percentile_approx("power", 0.95, 1000).alias("threshold"))
    return power.join(level, "center").withColumn("on", F.col("power") > F.col("threshold"))


@query()
def harmonic_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.remove_harmonics(by_center(spark, sf_dir), ["center"], "t", "m", [365.25, 182.6, 27.3])


@query()
def hilbert_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.instantaneous_period(by_center(spark, sf_dir), ["center"], "t", "m", 20, 40)


_marked = f"(SELECT center, s AS shift, m, (k + s * 7919) % n % 180 < 20 AS marked FROM (SELECT center, m, row_number() OVER (PARTITION BY center ORDER BY t) - 1 AS k, count(*) OVER (PARTITION BY center) AS n FROM {BY_CENTER} b) q, range(0, {DEFAULT.shifts + 1}) t(s))"
_gap = f"(SELECT center, shift, abs(stddev_pop(CASE WHEN marked THEN m END) - stddev_pop(CASE WHEN NOT marked THEN m END)) AS d FROM {_marked} m GROUP BY 1, 2)"


@query(f"SELECT a.center, {r('b.d')} AS real, {r('(cast(sum(CASE WHEN a.d >= b.d - 1e-12 THEN 1 ELSE 0 END) AS double) + 1) / (count(*) + 1)', 5)} AS p_value FROM {_gap} a JOIN {_gap} b ON a.center = b.center AND b.shift = 0 WHERE a.shift > 0 GROUP BY a.center, b.d")
def circular_shift_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p of the spread of a series on marked days against circular shifts of the marks, by a prime step each."""
    s = by_center(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("center").orderBy("t")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("center")))
    shifted = s.withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(DEFAULT.shifts)))).withColumn("marked", F.pmod(F.col("k") + F.col("shift") * 7919, F.col("n")) % 180 < 20)
    spread = shifted.groupBy("center", "shift").agg((F.stddev_pop(F.when(F.col("marked"), F.col("m"))) - F.stddev_pop(F.when(~F.col("marked"), F.col("m")))).alias("d"))
    real = spread.where("shift = 0").select("center", F.abs("d").alias("real"))
    out = spread.where("shift > 0").join(real, "center").groupBy("center", "real").agg(((F.sum((F.abs("d") >= F.col("real") - 1e-12).cast("int")) + 1) / (F.count("*") + 1)).alias("p_value"))
    return select(out, {"center": "center", "real": r("real"), "p_value": r("p_value", 5)})
