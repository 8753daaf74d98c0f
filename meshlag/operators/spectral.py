"""Cross-spectra of station pairs. Each station is transformed once, before the pair join.

Detrending, segment means and the taper are linear per station, so the band coefficients of a station are
grouped sums; a pair then needs one product per coefficient. Complex numbers are carried as (re, im).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def detrended(obs: DataFrame, keys: list[str], epoch: str = "e", value: str = "bias") -> DataFrame:
    """Adds idx (rank of the epoch in its series, from 0), n and x, the residual of a straight line."""
    w = Window.partitionBy(*keys)
    ranked = obs.withColumn("idx", (F.row_number().over(w.orderBy(epoch)) - 1).cast("double"))
    line = ranked.withColumns({"slope_": F.regr_slope(value, "idx").over(w), "icept_": F.regr_intercept(value, "idx").over(w), "n": F.count("*").over(w)})
    return line.withColumn("x", F.col(value) - F.coalesce(F.col("slope_") * F.col("idx") + F.col("icept_"), F.lit(0.0))).drop("slope_", "icept_")


def spectra(series: DataFrame, keys: list[str], size: int, bands: list[int]) -> DataFrame:
    """(keys, seg, k, re, im): Hann-tapered coefficients of half-overlapping segments of `size` samples."""
    step = size // 2
    seg = F.explode(F.array_distinct(F.array(F.floor(F.col("idx") / step), F.floor(F.col("idx") / step) - 1))).alias("seg")
    rows = series.select(*keys, "idx", "n", "x", seg).where((F.col("seg") >= 0) & (F.col("seg") * step + size <= F.col("n")))
    rows = rows.withColumn("t", F.col("idx") - F.col("seg") * step).withColumn("taper", 0.5 - 0.5 * F.cos(2 * np.pi * F.col("t") / size))
    rows = rows.withColumn("k", F.explode(F.array(*[F.lit(k) for k in bands]))).withColumn("angle", 2 * np.pi * F.col("k") * F.col("t") / size)
    c, s = F.col("taper") * F.cos("angle"), F.col("taper") * F.sin("angle")
    sums = rows.groupBy(*keys, "seg", "k").agg(F.sum(c * F.col("x")).alias("xc"), F.sum(s * F.col("x")).alias("xs"), F.sum(c).alias("c"), F.sum(s).alias("s"), F.avg("x").alias("m"))
    return sums.select(*keys, "seg", "k", (F.col("xc") - F.col("m") * F.col("c")).alias("re"), (-(F.col("xs") - F.col("m") * F.col("s"))).alias("im"))


#: Of the coefficients (ar, ai) and (br, bi) of a pair's segments.
CROSS_SUMS = {"sre": "sum(ar * br + ai * bi)", "sim": "sum(ar * bi - ai * br)", "pxx": "sum(ar * ar + ai * ai)", "pyy": "sum(br * br + bi * bi)", "segs": "count(*)"}


def _cross_sums() -> list[Column]:
    return [F.expr(v).alias(k) for k, v in CROSS_SUMS.items()]


def cross(spec: DataFrame, keys: list[str], station: str = "st") -> DataFrame:
    """(keys, i, j, k, sre, sim, pxx, pyy, segs): segment sums of conj(X) Y and of the powers, i < j."""
    a = spec.select(*keys, F.col(station).alias("i"), "seg", "k", F.col("re").alias("ar"), F.col("im").alias("ai"))
    b = spec.select(*keys, F.col(station).alias("j"), "seg", "k", F.col("re").alias("br"), F.col("im").alias("bi"))
    pairs = a.join(b, [*keys, "seg", "k"]).where("i < j")
    return pairs.groupBy(*keys, "i", "j", "k").agg(*_cross_sums())


def pair_measures(bands: DataFrame, keys: list[str]) -> DataFrame:
    """Band measures of each pair.

    phase is that of the band-summed cross-spectrum, which equals the magnitude-weighted circular mean.
    real_coherency, imag_coherency (mean of |Im|), pli and wpli are over the band's frequencies.
    """
    c = "sqrt(pxx * pyy)"
    return bands.groupBy(*keys, "i", "j").agg(
        F.atan2(F.sum("sim"), F.sum("sre")).alias("phase"), F.expr("avg(sqrt(sre * sre + sim * sim))").alias("magnitude"),
        F.expr(f"avg(CASE WHEN pxx * pyy > 0 THEN sre / {c} END)").alias("real_coherency"), F.expr(f"avg(CASE WHEN pxx * pyy > 0 THEN abs(sim) / {c} END)").alias("imag_coherency"),
        F.expr("abs(avg(sign(sim)))").alias("pli"), F.expr("CASE WHEN sum(abs(sim)) > 0 THEN abs(sum(sim)) / sum(abs(sim)) END").alias("wpli"), F.max("segs").alias("segs"),
    )


def band_indices(seconds: float, size: int, low_hz: float, high_hz: float) -> list[int]:
    """Frequency indices k with low <= k / (seconds * size) <= high, without the mean."""
    return [k for k in range(1, size // 2 + 1) if low_hz <= k / (seconds * size) <= high_hz]


def common_phases(obs: DataFrame, keys: list[str], pairs: DataFrame, size: int, bands: list[int], least: int, station: str = "st", epoch: str = "e", value: str = "bias") -> DataFrame:
    """(keys, i, j, n_epochs, phase, magnitude) of the `pairs` (keys, i, j), each on the epochs that both stations have.

    Common epochs are compacted, as the station path does with its own. The two ends of a pair are two series of
    grouped sums; only the epochs of the asked pairs are joined. Phases of fewer epochs than `least` or `size` are null.
    """
    a = obs.select(*keys, F.col(station).alias("i"), epoch, F.col(value).alias("x_i"))
    b = obs.select(*keys, F.col(station).alias("j"), epoch, F.col(value).alias("x_j"))
    both = pairs.select(*keys, "i", "j").join(a, [*keys, "i"]).join(b, [*keys, "j", epoch])
    ends = both.select(*keys, "i", "j", epoch, F.explode(F.array(*[F.struct(F.lit(e).alias("end"), F.col(f"x_{e}").alias("v")) for e in "ij"])).alias("s")).select(*keys, "i", "j", epoch, "s.end", "s.v")
    ids = [*keys, "i", "j"]
    spec = spectra(detrended(ends, [*ids, "end"], epoch, "v").where(F.col("n") >= max(least, size)), [*ids, "end"], size, bands)
    one, two = (spec.where(F.col("end") == e).select(*ids, "seg", "k", F.col("re").alias(f"{c}r"), F.col("im").alias(f"{c}i")) for e, c in (("i", "a"), ("j", "b")))
    measured = pair_measures(one.join(two, [*ids, "seg", "k"]).groupBy(*ids, "k").agg(*_cross_sums()), keys)
    counts = both.groupBy(*ids).agg(F.count("*").alias("n_epochs"))
    return counts.join(measured.select(*ids, "phase", "magnitude"), ids, "left")


def common_phases_sql(obs: str, key: str, size: int, bands: list[int], least: int) -> str:
    """Phases of all pairs as DuckDB text, every pair on its common epochs, with the rows that `phases` returns.

    `obs` has key, st, e and bias. Stations of fewer than `least` epochs are left out; a pair whose stations have the
    same epochs needs `size` of them.
    """
    step, enough = size // 2, max(least, size)
    kept = f"(SELECT *, count(*) OVER (PARTITION BY {key}, st) AS own FROM {obs} o)"
    both = f"(SELECT a.{key}, a.st AS i, b.st AS j, a.e, a.bias AS x_i, b.bias AS x_j, a.own AS n_i, b.own AS n_j FROM {kept} a JOIN {kept} b ON a.{key} = b.{key} AND a.e = b.e AND a.st < b.st WHERE a.own >= {least} AND b.own >= {least})"
    ends = f"(SELECT {key}, i, j, e, 'i' AS nd, x_i AS v FROM {both} u UNION ALL SELECT {key}, i, j, e, 'j', x_j FROM {both} u)"
    ranked = f"(SELECT *, cast(row_number() OVER (PARTITION BY {key}, i, j, nd ORDER BY e) - 1 AS double) AS idx, count(*) OVER (PARTITION BY {key}, i, j, nd) AS n FROM {ends} q)"
    series = f"(SELECT {key}, i, j, nd, idx, n, v - coalesce(regr_slope(v, idx) OVER w * idx + regr_intercept(v, idx) OVER w, 0) AS x FROM {ranked} z WHERE n >= {enough} WINDOW w AS (PARTITION BY {key}, i, j, nd))"
    angle = f"2 * pi() * k.k * (s.idx - g.seg * {step}) / {size}"
    cut_ = f"""(SELECT s.{key}, s.i, s.j, s.nd, g.seg, k.k, s.x, 0.5 - 0.5 * cos(2 * pi() * (s.idx - g.seg * {step}) / {size}) AS tp, cos({angle}) AS cs, sin({angle}) AS sn
        FROM {series} s JOIN range(0, 10000) g(seg) ON s.idx >= g.seg * {step} AND s.idx < g.seg * {step} + {size} AND g.seg * {step} + {size} <= s.n, (VALUES {', '.join(f'({b})' for b in bands)}) k(k))"""
    spec = f"(SELECT {key}, i, j, nd, seg, k, sum(tp * cs * x) - avg(x) * sum(tp * cs) AS re, -(sum(tp * sn * x) - avg(x) * sum(tp * sn)) AS im FROM {cut_} q GROUP BY ALL)"
    cross_ = f"(SELECT a.{key}, a.i, a.j, a.k, sum(a.re * b.re + a.im * b.im) AS sre, sum(a.re * b.im - a.im * b.re) AS sim FROM {spec} a JOIN {spec} b ON a.{key} = b.{key} AND a.i = b.i AND a.j = b.j AND a.seg = b.seg AND a.k = b.k AND a.nd = 'i' AND b.nd = 'j' GROUP BY 1, 2, 3, 4)"
    measured = f"(SELECT {key}, i, j, atan2(sum(sim), sum(sre)) AS phase, avg(sqrt(sre * sre + sim * sim)) AS magnitude FROM {cross_} c GROUP BY 1, 2, 3)"
    counts = f"(SELECT {key}, i, j, count(*) AS n_epochs, any_value(n_i) AS n_i, any_value(n_j) AS n_j FROM {both} b GROUP BY 1, 2, 3)"
    return f"(SELECT c.{key}, c.i, c.j, n_epochs, phase, magnitude FROM {counts} c LEFT JOIN {measured} m ON m.{key} = c.{key} AND m.i = c.i AND m.j = c.j WHERE phase IS NOT NULL OR n_epochs <> n_i OR n_epochs <> n_j)"


def phases(obs: DataFrame, keys: list[str], size: int, bands: list[int], least: int, station: str = "st", epoch: str = "e", value: str = "bias") -> DataFrame:
    """Phase of every pair: the station path where both have the same epochs, their common epochs elsewhere."""
    signed = obs.groupBy(*keys, station).agg(F.xxhash64(F.array_sort(F.collect_list(epoch))).alias("sig"), F.count("*").alias("n_epochs")).where(F.col("n_epochs") >= least)
    a, b = (signed.select(*keys, F.col(station).alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n_epochs").alias(f"n_{x}")) for x in "ij")
    pairs = a.join(b, keys).where("i < j")
    kept = obs.join(signed.select(*keys, station), [*keys, station], "left_semi")
    series = detrended(kept, [*keys, station], epoch, value)
    fast = pair_measures(cross(spectra(series, [*keys, station], size, bands), keys, station), keys)
    same = pairs.where("sig_i = sig_j").join(fast, [*keys, "i", "j"]).select(*keys, "i", "j", F.col("n_i").alias("n_epochs"), "phase", "magnitude")
    return same.unionByName(common_phases(kept, keys, pairs.where("sig_i <> sig_j"), size, bands, least, station, epoch, value))
