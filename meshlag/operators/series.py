"""Operators on keyed daily or epoch series: windows, smoothing, lags, spectra, wavelets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def gradient(df: DataFrame, keys: list[str], t: str, y: str, name: str = "gradient") -> DataFrame:
    """Second-order central differences for unequal steps; one-sided at the ends; null for a lone row."""
    w = _w(keys, t)
    hs, hd = F.col(t) - F.lag(t).over(w), F.lead(t).over(w) - F.col(t)
    before, after = F.col(y) - F.lag(y).over(w), F.lead(y).over(w) - F.col(y)
    middle = (hs * hs * after + hd * hd * before) / (hs * hd * (hd + hs))
    return df.withColumn(name, F.coalesce(middle, after / hd, before / hs))


def unwrap(df: DataFrame, keys: list[str], t: str, phase: str, name: str = "unwrapped") -> DataFrame:
    """Adds multiples of 2 pi so that successive phases differ by at most pi."""
    w = _w(keys, t)
    step = F.coalesce(F.col(phase) - F.lag(phase).over(w), F.lit(0.0))
    turned = df.withColumn("_turn", -2 * np.pi * F.ceil((step - np.pi) / (2 * np.pi)))
    return turned.withColumn(name, F.col(phase) + F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_turn")


def rolling_median(df: DataFrame, keys: list[str], t: str, y: str, half: int = 1, name: str = "median") -> DataFrame:
    """Centred median of 2 * half + 1 rows; null where the window is not full."""
    w = _w(keys, t).rowsBetween(-half, half)
    rows = F.array_sort(F.collect_list(y).over(w))
    return df.withColumn(name, F.when(F.count(y).over(w) == 2 * half + 1, F.element_at(rows, half + 1)))


def wrapped_step(df: DataFrame, keys: list[str], t: str, angle: str, name: str = "turn") -> DataFrame:
    """Change of an angle from row to row, within [-pi, pi)."""
    d = F.col(angle) - F.lag(angle).over(_w(keys, t))
    return df.withColumn(name, F.pmod(d + np.pi, F.lit(2 * np.pi)) - np.pi)


def smooth(df: DataFrame, keys: list[str], t: str, y: str, weights: list[float], name: str = "smooth", renormalise: bool = True) -> DataFrame:
    """Centred weighted mean over rows; missing values drop out and the present weights are renormalised."""
    half = len(weights) // 2
    w = _w(keys, t)
    terms, norm = F.lit(0.0), F.lit(0.0)
    for k, weight in enumerate(weights):
        v = F.lag(y, half - k).over(w) if k <= half else F.lead(y, k - half).over(w)
        terms = terms + F.coalesce(v * weight, F.lit(0.0))
        norm = norm + F.when(v.isNotNull(), F.lit(weight)).otherwise(0.0)
    return df.withColumn(name, F.when(norm != 0, terms / norm) if renormalise else terms)


def gaussian_weights(half: int, sigma: float) -> list[float]:
    return [float(np.exp(-0.5 * (k / sigma) ** 2)) for k in range(-half, half + 1)]


def savgol_weights(window: int = 31, order: int = 3) -> list[float]:
    """Least-squares polynomial smoothing as fixed weights."""
    half = window // 2
    a = np.vander(np.arange(-half, half + 1), order + 1, increasing=True)
    return [float(x) for x in np.linalg.pinv(a)[0]]


def prewhiten(df: DataFrame, keys: list[str], t: str, y: str, limit: float = 0.99) -> DataFrame:
    """Adds phi (lag-one correlation, clipped) and white = y - phi * previous y."""
    lagged = df.withColumn("_l", F.lag(y).over(_w(keys, t)))
    phi = F.least(F.lit(limit), F.greatest(F.lit(-limit), F.coalesce(F.corr(y, "_l").over(Window.partitionBy(*keys)), F.lit(0.0))))
    return lagged.withColumn("phi", phi).withColumn("white", F.col(y) - F.col("phi") * F.col("_l")).drop("_l")


def cross_correlation(a: DataFrame, b: DataFrame, keys: list[str], t: str, y: str, most: int) -> DataFrame:
    """(keys, lag, r, n): mean product of standardised values of b at t + lag and a at t, |lag| <= most.

    Each row of a is sent to 2 * most + 1 lags and meets b by equality, so the join grows with the lags.
    """
    def standard(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(*keys)
        return df.select(*keys, t, ((F.col(y) - F.avg(y).over(w)) / F.stddev_pop(y).over(w)).alias(name))

    left = standard(a, "za").withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn(t, F.col(t) + F.col("lag"))
    return left.join(standard(b, "zb"), [*keys, t]).groupBy(*keys, "lag").agg(F.avg(F.col("za") * F.col("zb")).alias("r"), F.count("*").alias("n"))


def multitaper_psd(df: DataFrame, keys: list[str], idx: str, y: str, n: str, tapers: int, freqs: int) -> DataFrame:
    """(keys, k, power): mean power over sine tapers at frequencies k / (2 n), k = 1..freqs.

    Sine tapers have a closed form and nearly the concentration of Slepian tapers of the same number.
    """
    rows = df.withColumn("taper", F.explode(F.sequence(F.lit(1), F.lit(tapers)))).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(freqs))))
    h = F.sqrt(2 / (F.col(n) + 1)) * F.sin(np.pi * F.col("taper") * (F.col(idx) + 1) / (F.col(n) + 1))
    angle = np.pi * F.col("k") * F.col(idx) / F.col(n)
    sums = rows.groupBy(*keys, "k", "taper").agg(F.sum(h * F.col(y) * F.cos(angle)).alias("re"), F.sum(h * F.col(y) * F.sin(angle)).alias("im"))
    return sums.groupBy(*keys, "k").agg(F.avg(F.expr("re * re + im * im")).alias("power"))


def local_snr(psd: DataFrame, keys: list[str], k: str = "k", power: str = "power", half: int = 8) -> DataFrame:
    """Power over the median of the neighbours within `half` bins, the bin itself left out."""
    w = _w(keys, k)
    near = F.array_sort(F.concat(F.collect_list(power).over(w.rowsBetween(-half, -1)), F.collect_list(power).over(w.rowsBetween(1, half))))
    m = F.size(near)
    median = (F.element_at(near, F.floor((m + 1) / 2).cast("int")) + F.element_at(near, F.floor(m / 2 + 1).cast("int"))) / 2
    return psd.withColumn("snr", F.when(m > 0, F.col(power) / median))


def morlet_power(df: DataFrame, keys: list[str], t: str, y: str, scales: list[float], reach: float = 4.0, omega: float = 6.0) -> DataFrame:
    """(keys, scale, t, power) of a Morlet wavelet transform by direct convolution, sums within `reach` scales.

    A sample is sent to the times it can reach and summed there: rows grow with the series times the reach.
    """
    rows = df.select(*keys, F.col(t).alias("u"), F.col(y).alias("y")).withColumn("scale", F.explode(F.array(*[F.lit(float(s)) for s in scales])))
    far = F.floor(F.col("scale") * reach).cast("int")
    rows = rows.withColumn("d", F.explode(F.sequence(-far, far))).withColumn(t, F.col("u") + F.col("d"))
    x = F.col("d") / F.col("scale")
    weight = F.exp(-0.5 * x * x) * float(np.pi**-0.25) / F.sqrt("scale")
    sums = rows.groupBy(*keys, "scale", t).agg(F.sum(F.col("y") * weight * F.cos(omega * x)).alias("re"), F.sum(F.col("y") * weight * F.sin(omega * x)).alias("im"))
    inside = sums.join(df.select(*keys, t).distinct(), [*keys, t], "left_semi")
    return inside.select(*keys, "scale", t, F.expr("re * re + im * im").alias("power"))


def morlet_by_series(df: DataFrame, keys: list[str], t: str, y: str, scales: list[float], reach: float = 4.0, omega: float = 6.0) -> DataFrame:
    """As `morlet_power`, with one series a group: no row is fanned out, for long scales and many series."""
    schema = ", ".join([*(f"{k} {dict(df.dtypes)[k]}" for k in keys), f"scale double, {t} {dict(df.dtypes)[t]}, power double"])

    def transform(pdf: pd.DataFrame) -> pd.DataFrame:
        u = pdf[t].to_numpy(np.int64)
        v = np.zeros(u.max() - u.min() + 1)
        np.add.at(v, u - u.min(), pdf[y].fillna(0).to_numpy(float))
        at = np.unique(u)
        out = []
        for s in scales:
            far = int(s * reach)
            x = np.arange(-far, far + 1) / s
            z = np.convolve(v, np.exp(-0.5 * x * x + 1j * omega * x) * np.pi**-0.25 / np.sqrt(s))[far : far + len(v)][at - u.min()]
            out.append(pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(at) for k in keys}, "scale": float(s), t: at, "power": np.abs(z) ** 2}))
        return pd.concat(out)

    return df.select(*keys, t, F.col(y).cast("double").alias(y)).groupBy(*keys).applyInPandas(transform, schema)


def band_power(spectrum: DataFrame, keys: list[str], period: str, power: str, targets: tuple[float, ...], width: float = 0.2) -> DataFrame:
    """(keys, target, band_power): mean power over the periods within `width` times a target of it."""
    rows = spectrum.withColumn("target", F.explode(F.array(*[F.lit(float(x)) for x in targets])))
    return rows.where(F.abs(F.col(period) - F.col("target")) <= width * F.col("target")).groupBy(*keys, "target").agg(F.avg(power).alias("band_power"))


def stable_peak(spectrum: DataFrame, keys: list[str], period: str, power: str, half: int) -> DataFrame:
    """(keys, peak_period): mean period, weighted by power, over the strongest line and `half` lines on either side."""
    w = Window.partitionBy(*keys)
    placed = spectrum.withColumn("_k", F.row_number().over(w.orderBy(period)))
    near = placed.withColumn("_top", F.max_by("_k", F.struct(F.col(power), -F.col("_k"))).over(w)).where(F.abs(F.col("_k") - F.col("_top")) <= half)
    return near.groupBy(*keys).agg((F.sum(F.col(period) * F.col(power)) / F.sum(power)).alias("peak_period"))


def block_bootstrap_p(df: DataFrame, keys: list[str], idx: str, y: str, n: str, lines: tuple[float, ...], tapers: int, block: int, replicates: int) -> DataFrame:
    """(keys, line, power, p_value): share of moving-block resamples with at least the observed power at each period.

    A replicate is a list of blocks whose starts are hashed; blocks become places, places meet the series by
    equality, and the transforms of all replicates are grouped sums. The count of the observed itself is in p.
    """
    sizes = df.groupBy(*keys).agg(F.first(n).alias("n")).where(F.col("n") >= block)
    blocks = sizes.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / block) - 1)))
    start = F.conv(F.substring(F.md5(F.concat_ws("#", *keys, F.col("replicate").cast("string"), F.col("b").cast("string"))), 1, 8), 16, 10).cast("long") % (F.col("n") - block + 1)
    places = blocks.withColumn("start", start).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).select(*keys, "replicate", "n", (F.col("b") * block + F.col("o")).alias("at"), (F.col("start") + F.col("o")).alias("src")).where("at < n")
    base = df.select(*keys, F.col(idx).cast("long").alias("src"), F.col(y).alias("y"))
    drawn = places.join(base, [*keys, "src"]).select(*keys, "replicate", "at", "n", "y")
    rows = drawn.unionByName(df.select(*keys, F.lit(0).alias("replicate"), F.col(idx).cast("long").alias("at"), F.col(n).alias("n"), F.col(y).alias("y")))
    rows = rows.withColumn("taper", F.explode(F.sequence(F.lit(1), F.lit(tapers)))).withColumn("line", F.explode(F.array(*[F.lit(float(x)) for x in lines])))
    h = F.sqrt(2 / (F.col("n") + 1)) * F.sin(np.pi * F.col("taper") * (F.col("at") + 1) / (F.col("n") + 1))
    angle = 2 * np.pi * F.col("at") / F.col("line")
    part = lambda f: F.sum(h * F.col("y") * f(angle)) - F.avg("y") * F.sum(h * f(angle))
    power = rows.groupBy(*keys, "replicate", "line", "taper").agg(part(F.cos).alias("re"), part(F.sin).alias("im")).groupBy(*keys, "replicate", "line").agg(F.avg(F.expr("re * re + im * im")).alias("power"))
    real = power.where("replicate = 0").select(*keys, "line", F.col("power").alias("real"))
    return power.where("replicate > 0").join(real, [*keys, "line"]).groupBy(*keys, "line", F.col("real").alias("power")).agg(((F.sum((F.col("power") >= F.col("real")).cast("int")) + 1) / (F.count("*") + 1)).alias("p_value"))


def ar1_spectrum(frequency: Column, phi: Column, variance: Column) -> Column:
    return variance / (1 + phi * phi - 2 * phi * F.cos(2 * np.pi * frequency))


def remove_harmonics(df: DataFrame, keys: list[str], t: str, y: str, periods: list[float]) -> DataFrame:
    """Residual of a least-squares fit of sines and cosines at known periods; one group is one series."""
    schema = ", ".join([*(f"{k} {dict(df.dtypes)[k]}" for k in keys), f"{t} {dict(df.dtypes)[t]}, {y} double, residual double"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[t].to_numpy(float)
        cols = [np.ones(len(x))] + [f(2 * np.pi * x / p) for p in periods for f in (np.sin, np.cos)]
        a = np.column_stack(cols)
        coef, *_ = np.linalg.lstsq(a, pdf[y].to_numpy(float), rcond=None)
        return pdf.assign(residual=pdf[y] - a @ coef)

    return df.select(*keys, t, F.col(y).cast("double").alias(y)).groupBy(*keys).applyInPandas(fit, schema)


def instantaneous_period(df: DataFrame, keys: list[str], t: str, y: str, low: float, high: float) -> DataFrame:
    """Amplitude and instantaneous period of the series in the band of periods [low, high].

    Band mask and analytic signal by FFT over one series a group; times are taken as equally spaced.
    """
    schema = ", ".join([*(f"{k} {dict(df.dtypes)[k]}" for k in keys), f"{t} {dict(df.dtypes)[t]}, amplitude double, period double"])

    def analyse(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        v = pdf[y].to_numpy(float)
        n = len(v)
        f = np.fft.fft(v - v.mean())
        freq = np.fft.fftfreq(n)
        keep = (freq > 0) & (freq >= 1 / high) & (freq <= 1 / low)
        z = np.fft.ifft(np.where(keep, 2 * f, 0))
        rate = np.gradient(np.unwrap(np.angle(z))) / (2 * np.pi) if n > 1 else np.zeros(n)
        amplitude = np.abs(z)
        period = np.where((rate > 0) & (amplitude > 0.3 * np.median(amplitude)), 1 / np.where(rate > 0, rate, 1), np.nan)
        return pdf[[*keys, t]].assign(amplitude=amplitude, period=period)

    return df.select(*keys, t, F.col(y).cast("double").alias(y)).groupBy(*keys).applyInPandas(analyse, schema)


def ar1_surrogates(df: DataFrame, keys: list[str], t: str, y: str, count: int, seed: int = 42) -> DataFrame:
    """(keys, surrogate, t, value): AR(1) series with the lag-one correlation and variance of each series.

    Surrogate ids fan out first, so a task makes one series at a time.
    """
    stats = df.withColumn("_l", F.lag(y).over(_w(keys, t))).groupBy(*keys).agg(F.coalesce(F.corr(y, "_l"), F.lit(0.0)).alias("phi"), F.coalesce(F.stddev_pop(y), F.lit(0.0)).alias("sd"), F.array_sort(F.collect_list(t)).alias("ts"))
    rows = stats.withColumn("surrogate", F.explode(F.sequence(F.lit(1), F.lit(count))))
    schema = ", ".join([*(f"{k} {dict(df.dtypes)[k]}" for k in keys), f"surrogate int, {t} {dict(df.dtypes)[t]}, value double"])

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples(index=False):
            rng = np.random.default_rng([seed, int(r.surrogate)])
            phi = float(np.clip(r.phi, -0.99, 0.99))
            e = rng.standard_normal(len(r.ts)) * r.sd * np.sqrt(1 - phi * phi)
            v = np.zeros(len(e))
            for k in range(len(e)):
                v[k] = (phi * v[k - 1] if k else 0) + e[k]
            out.append(pd.DataFrame({**{k: [getattr(r, k)] * len(v) for k in keys}, "surrogate": r.surrogate, t: list(r.ts), "value": v}))
        return pd.concat(out) if out else pd.DataFrame(columns=[*keys, "surrogate", t, "value"])

    return rows.groupBy(*keys, "surrogate").applyInPandas(make, schema)
