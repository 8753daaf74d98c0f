"""Weighted decay fits for every group at once, by variable projection.

For a fixed shape parameter the model A g(r; theta) + C is linear, so a grid of theta turns fitting into
grouped sums: rows are bins x grid points, and the best theta of a group is a min_by. Thousands of groups
are fitted by the same few aggregations, and no row ever goes to Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlag.functions.cut import cut
from meshlag.operators.steps import Steps, apply, nest

GRID, REFINE, HALF = 60, 3, 12
A_LOW, A_HIGH, C_LOW, C_HIGH = 1e-10, 5.0, -1.0, 1.0


@dataclass(frozen=True)
class Model:
    """`basis` is text with {r} and {t}; t lies in [low, high] and is searched on a logarithmic grid."""

    name: str
    basis: str
    low: float
    high: float

    def g(self, r: str, t: str) -> str:
        return self.basis.format(r=f"({r})", t=f"({t})")


MODELS = {
    m.name: m
    for m in (
        Model("exponential", "exp(-{r} / {t})", 100, 20_000),
        Model("gaussian", "exp(-pow({r} / {t}, 2))", 100, 20_000),
        Model("squared_exponential", "exp(-0.5 * pow({r} / {t}, 2))", 100, 20_000),
        Model("power_law", "pow({r}, -{t})", 0.1, 10),
        Model("matern_1_5", "((1 + 1.7320508075688772 * {r} / {t}) * exp(-1.7320508075688772 * {r} / {t}))", 100, 20_000),
        Model("matern_2_5", "((1 + 2.23606797749979 * {r} / {t} + 5 * {r} * {r} / (3 * {t} * {t})) * exp(-2.23606797749979 * {r} / {t}))", 100, 20_000),
        Model("power_law_shifted", "pow({r} + 1, -{t})", 0.01, 5),
    )
}


def cutoff_models(alphas: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0)) -> list[Model]:
    """Power law with an exponential cut-off: one model for each exponent, the cut-off is searched."""
    return [Model(f"power_cutoff_{a:g}", f"(pow({{r}}, -{a}) * exp(-{{r}} / {{t}}))", 100, 20_000) for a in alphas]


def _clamp(x: str, lo: float, hi: float) -> str:
    return f"least(cast({hi} AS double), greatest(cast({lo} AS double), {x}))"


def _wrss(a: str, c: str) -> str:
    return f"(syy - 2 * {a} * sgy - 2 * {c} * sy + {a} * {a} * sgg + 2 * {a} * {c} * sg + {c} * {c} * sw)"


#: From the sums of a grid point to amplitude, offset and weighted residual, inside the box.
SOLVE: Steps = [
    {"det": "sw * sgg - sg * sg"},
    {"a0": f"CASE WHEN det > 1e-12 * sw * sgg THEN (sw * sgy - sg * sy) / det ELSE cast({A_LOW} AS double) END"},
    {"a1": _clamp("a0", A_LOW, A_HIGH)},
    {"c1": _clamp("(sy - a1 * sg) / sw", C_LOW, C_HIGH)},
    {"a2": _clamp("CASE WHEN sgg > 0 THEN (sgy - c1 * sg) / sgg ELSE a1 END", A_LOW, A_HIGH)},
    {"w1": _wrss("a1", "c1"), "w2": _wrss("a2", "c1")},
    {"amplitude": "CASE WHEN w2 < w1 THEN a2 ELSE a1 END", "offset_c": "c1", "wrss": "greatest(0.0D, least(w1, w2))"},
]
SUMS = {"sw": "sum(w)", "sg": "sum(w * g)", "sgg": "sum(w * g * g)", "sy": "sum(w * y)", "sgy": "sum(w * g * y)", "syy": "sum(w * y * y)", "n_bins": "count(*)"}
#: The same sums where rows of one distance are folded into their sums.
FOLDED = {**SUMS, "sy": "sum(wy)", "sgy": "sum(g * wy)", "syy": "sum(wyy)", "n_bins": "sum(m)"}
BEST = ("theta", "amplitude", "offset_c", "wrss", "sw", "sy", "syy", "n_bins")

#: Diagnostics of the best point; three parameters.
DIAGNOSE: Steps = [
    {"tss": "syy - sy * sy / sw"},
    {"r2": "CASE WHEN tss > 0 THEN 1 - wrss / tss END", "aic": "CASE WHEN wrss > 0 THEN n_bins * ln(wrss / n_bins) + 6 END", "bic": "CASE WHEN wrss > 0 THEN n_bins * ln(wrss / n_bins) + 3 * ln(n_bins) END"},
]


#: Sums of the products of the slopes d (theta), g (amplitude) and 1 (offset): the matrix J'WJ.
ERROR_SUMS = {"e_dd": "sum(w * d * d)", "e_dg": "sum(w * d * g)", "e_d1": "sum(w * d)", "e_gg": "sum(w * g * g)", "e_g1": "sum(w * g)", "e_11": "sum(w)"}
#: Its inverse by cofactors, times the residual variance; null where the parameters can't be told apart.
COVARIANCE: Steps = [
    {"f_dd": "e_gg * e_11 - e_g1 * e_g1", "f_gg": "e_dd * e_11 - e_d1 * e_d1", "f_11": "e_dd * e_gg - e_dg * e_dg", "f_dg": "e_g1 * e_d1 - e_dg * e_11", "f_d1": "e_dg * e_g1 - e_gg * e_d1", "f_g1": "e_dg * e_d1 - e_dd * e_g1"},
    {"f_det": "e_dd * f_dd + e_dg * f_dg + e_d1 * f_d1"},
    {"f_s": "CASE WHEN f_det > 1e-14 * e_dd * e_gg * e_11 AND n_bins > 3 THEN wrss / (n_bins - 3) / f_det END"},
    {
        "se_theta": "sqrt(f_s * f_dd)", "se_amplitude": "sqrt(f_s * f_gg)", "se_offset_c": "sqrt(f_s * f_11)",
        "corr_theta_amplitude": "CASE WHEN f_s IS NOT NULL THEN f_dg / sqrt(f_dd * f_gg) END", "corr_theta_offset_c": "CASE WHEN f_s IS NOT NULL THEN f_d1 / sqrt(f_dd * f_11) END", "corr_amplitude_offset_c": "CASE WHEN f_s IS NOT NULL THEN f_g1 / sqrt(f_gg * f_11) END",
    },
]


def _case(models: list[Model], value) -> str:
    """`value` of the row's model; models are told apart by the column `model`."""
    if len(models) == 1:
        return value(models[0])
    return "CASE model " + " ".join(f"WHEN '{m.name}' THEN {value(m)}" for m in models) + " END"


def _points(bins: DataFrame, keys: list[str], models: list[Model], named: dict[str, str]) -> DataFrame:
    g = bins.withColumn("g", F.expr(_case(models, lambda m: m.g("r", "theta"))))
    sums = g.groupBy(*keys, "theta").agg(*[F.expr(v).alias(k) for k, v in named.items()])
    best = apply(sums, SOLVE).groupBy(*keys).agg(F.min_by(F.struct(*BEST), F.struct("wrss", "theta")).alias("best"))
    return best.select(*keys, "best.*")


#: Columns of a fit's result.
RESULT = ("theta", "amplitude", "offset_c", "wrss", "n_bins", "r2", "aic", "bic", "at_bound", "model", "se_theta", "se_amplitude", "se_offset_c", "corr_theta_amplitude", "corr_theta_offset_c", "corr_amplitude_offset_c")


def fit_decay(
    bins: DataFrame, keys: list[str], model: str | Model | list[str | Model] = "exponential", r: str = "distance_km", y: str = "mean_coherence", w: str = "n", errors: bool = False, together: bool = True
) -> DataFrame:
    """One row for each group of `keys` and model: theta, amplitude, offset_c, wrss, r2, aic, bic, n_bins, at_bound, model.

    `together` moves each group to one task once, which suits bins (a few dozen rows a group); without it the
    sums are combined across tasks, which suits fits on single rows: those of one group and distance are first
    folded into their sums, which is all that the grid needs of them, so it is read by pairs of stations. A list of models is fitted in the same
    few aggregations, with the model as a further key. Weights are `w` (sigma = 1/sqrt(w)). Groups of under
    four bins are left out. The grid is refined around each group's best point three times, to about two parts
    in 10**5 of theta. `errors` adds the standard errors of all three parameters and their correlations. Keys may
    have any names but those of the result.
    """
    if taken := set(RESULT) & set(keys):
        raise ValueError(f"the result has columns of these names: {sorted(taken)}")
    inner = [f"_key{k}" for k in range(len(keys))]
    named = bins.select(*[F.col(k).alias(i) for k, i in zip(keys, inner, strict=True)], F.col(r).cast("double").alias("r"), F.col(y).cast("double").alias("y"), F.col(w).cast("double").alias("w"))
    return _fit(named, inner, model, errors, together).withColumnsRenamed(dict(zip(inner, keys, strict=True)))


def _fit(bins: DataFrame, keys: list[str], model: str | Model | list[str | Model], errors: bool, together: bool) -> DataFrame:
    """`fit_decay` on columns r, y, w and keys whose names nothing in here uses."""
    models = [MODELS[m] if isinstance(m, str) else m for m in (model if isinstance(model, list) else [model])]
    base = bins.where("r IS NOT NULL AND y IS NOT NULL AND w > 0")
    if not together:
        base = base.groupBy(*keys, "r").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("wyy"), F.count("*").alias("m"))
    base, named = cut(base), SUMS if together else FOLDED  # the rounds below read it again, not the facts behind it
    if len(models) > 1:
        base, keys = base.withColumn("model", F.explode(F.array(*[F.lit(m.name) for m in models]))), [*keys, "model"]
    if together and keys:
        base = base.repartition(*keys)  # all sums of a group are then taken where it lies
    low, high, log_step = (_case(models, f) for f in (lambda m: repr(float(m.low)), lambda m: repr(float(m.high)), lambda m: f"(ln({m.high / m.low!r}) / {GRID})"))
    grid = F.expr(f"transform(sequence(0, {GRID}), k -> {low} * exp(k * {log_step}))")
    best = _points(base.withColumn("theta", F.explode(grid)), keys, models, named)
    for level in range(1, REFINE + 1):
        near = F.expr(f"transform(sequence(-{HALF}, {HALF}), k -> least({high}, greatest({low}, centre * exp(k * {log_step} / {HALF**level}))))")
        centres = best.select(*keys, F.col("theta").alias("centre"))
        joined = base.join(centres, keys) if keys else base.crossJoin(F.broadcast(centres))
        best = _points(joined.withColumn("theta", F.explode(F.array_distinct(near))), keys, models, named)
    out = apply(best, DIAGNOSE).where("n_bins >= 4")
    out = out.withColumn("at_bound", F.expr(f"theta <= {low} * 1.0001D OR theta >= {high} * 0.9999D"))
    if errors:
        at = out.select(*keys, "theta", "amplitude")
        joined = base.join(at, keys) if keys else base.crossJoin(F.broadcast(at))
        slope = _case(models, lambda m: f"amplitude * ({m.g('r', 'theta * 1.0001')} - {m.g('r', 'theta * 0.9999')}) / (0.0002 * theta)")
        sums = joined.withColumns({"g": F.expr(_case(models, lambda m: m.g("r", "theta"))), "d": F.expr(slope)})
        sums = sums.groupBy(*keys).agg(*[F.expr(v).alias(k) for k, v in ERROR_SUMS.items()])
        out = apply(out.join(sums, keys) if keys else out.crossJoin(F.broadcast(sums)), COVARIANCE).drop(*ERROR_SUMS, *[k for step in COVARIANCE[:-1] for k in step])
    out = out.drop("sw", "sy", "syy", "tss")
    return out if len(models) > 1 else out.withColumn("model", F.lit(models[0].name))


#: Exponent and cut-off of a power law that falls off exponentially; both are searched. Bounds, grid points on either axis.
TWO_BASIS = "(pow({r}, -{a}) * exp(-{r} / {t}))"
ALPHA_LOW, ALPHA_HIGH, CUT_LOW, CUT_HIGH, TWO_GRID, TWO_HALF, TWO_ROUNDS = 0.1, 10.0, 1000.0, 20_000.0, 24, 4, 8
#: Four parameters.
TWO_DIAGNOSE: Steps = [
    {"tss": "syy - sy * sy / sw"},
    {"r2": "CASE WHEN tss > 0 THEN 1 - wrss / tss END", "aic": "CASE WHEN wrss > 0 THEN n_bins * ln(wrss / n_bins) + 8 END", "bic": "CASE WHEN wrss > 0 THEN n_bins * ln(wrss / n_bins) + 4 * ln(n_bins) END"},
]
TWO_BEST = ("alpha", *BEST)


def _two_steps(level: int) -> tuple[str, str]:
    """Points of both axes around a centre, in steps of the logarithm: those of the first grid, halved at each level."""
    a = f"least({ALPHA_HIGH}D, greatest({ALPHA_LOW}D, alpha0 * exp(ka * {math.log(ALPHA_HIGH / ALPHA_LOW) / TWO_GRID / 2**level!r}D)))"
    t = f"least({CUT_HIGH}D, greatest({CUT_LOW}D, theta0 * exp(kt * {math.log(CUT_HIGH / CUT_LOW) / TWO_GRID / 2**level!r}D)))"
    return a, t


def fit_cutoff(bins: DataFrame, keys: list[str], r: str = "distance_km", y: str = "mean_coherence", w: str = "n") -> DataFrame:
    """The power law with an exponential cut-off, exponent and cut-off searched together: one row a group of five bins or more.

    For a fixed pair (alpha, theta) the model is linear in amplitude and offset, so a grid of pairs turns the fit
    into grouped sums. Along the valley of pairs that fit alike the two trade off, so each round looks at all pairs
    of TWO_HALF steps around the best one and then halves both steps.
    """
    if taken := {*TWO_BEST, "r2", "aic", "bic", "model"} & set(keys):
        raise ValueError(f"the result has columns of these names: {sorted(taken)}")
    inner = [f"_key{k}" for k in range(len(keys))]
    base = bins.select(*[F.col(k).alias(i) for k, i in zip(keys, inner, strict=True)], F.col(r).cast("double").alias("r"), F.col(y).cast("double").alias("y"), F.col(w).cast("double").alias("w"))
    base = cut(base.where("r > 0 AND y IS NOT NULL AND w > 0"))
    if inner:
        base = base.repartition(*inner)
    first = {"alpha0": F.lit(ALPHA_LOW), "theta0": F.lit(CUT_LOW)}
    near, span = base.withColumns(first), (0, TWO_GRID)
    for level in range(TWO_ROUNDS + 1):
        alpha, theta = _two_steps(level)
        steps = F.sequence(F.lit(span[0]), F.lit(span[1]))
        points = near.withColumn("ka", F.explode(steps)).withColumn("kt", F.explode(steps)).withColumns({"alpha": F.expr(alpha), "theta": F.expr(theta)})
        sums = points.withColumn("g", F.expr(TWO_BASIS.format(r="r", a="alpha", t="theta"))).groupBy(*inner, "alpha", "theta", "ka", "kt").agg(*[F.expr(v).alias(k) for k, v in SUMS.items()])
        best = apply(sums, SOLVE).groupBy(*inner).agg(F.min_by(F.struct(*TWO_BEST), F.struct("wrss", "ka", "kt")).alias("best")).select(*inner, "best.*")
        centres = best.select(*inner, F.col("alpha").alias("alpha0"), F.col("theta").alias("theta0"))
        near, span = base.join(centres, inner) if inner else base.crossJoin(F.broadcast(centres)), (-TWO_HALF, TWO_HALF)  # one row a group
    out = apply(best, TWO_DIAGNOSE).where("n_bins >= 5")
    return out.select(*inner, "alpha", "theta", "amplitude", "offset_c", "wrss", "r2", "aic", "bic", "n_bins").withColumnsRenamed(dict(zip(inner, keys, strict=True)))


def fit_cutoff_sql(bins: str, keys: list[str], r: str = "distance_km", y: str = "mean_coherence", w: str = "n") -> str:
    """The same search as DuckDB text."""
    ks = "".join(f"{k}, " for k in keys)
    base = f"(SELECT {ks}cast({r} AS double) AS r, cast({y} AS double) AS y, cast({w} AS double) AS w FROM {bins} WHERE {r} > 0 AND {y} IS NOT NULL AND {w} > 0)"
    near = f"(SELECT b.*, {ALPHA_LOW}::double AS alpha0, {CUT_LOW}::double AS theta0 FROM {base} b)"
    span, group = (0, TWO_GRID + 1), f"GROUP BY {', '.join(keys)}" if keys else ""
    best = ""
    for level in range(TWO_ROUNDS + 1):
        alpha, theta = (x.replace("D", "") for x in _two_steps(level))
        points = f"(SELECT *, {alpha} AS alpha, {theta} AS theta FROM {near} n, range({span[0]}, {span[1]}) a(ka), range({span[0]}, {span[1]}) t(kt))"
        sums = f"(SELECT {ks}alpha, theta, ka, kt, {', '.join(f'{v} AS {k}' for k, v in SUMS.items())} FROM (SELECT *, {TWO_BASIS.format(r='r', a='alpha', t='theta')} AS g FROM {points} p) q GROUP BY {ks}alpha, theta, ka, kt)"
        best = f"(SELECT {ks}b.* FROM (SELECT {ks}min_by({{{', '.join(f'{x!r}: {x}' for x in TWO_BEST)}}}, (wrss, ka, kt)) AS b FROM {nest(sums, SOLVE)} m {group}) o)"
        match = " AND ".join(f"f.{k} = c.{k}" for k in keys) or "true"
        near, span = f"(SELECT f.*, c.alpha AS alpha0, c.theta AS theta0 FROM {base} f JOIN {best} c ON {match})", (-TWO_HALF, TWO_HALF + 1)
    return f"(SELECT * FROM {nest(best, TWO_DIAGNOSE)} z WHERE n_bins >= 5)".replace("0.0D", "0.0")


def fit_decay_sql(bins: str, keys: list[str], model: str | Model = "exponential", r: str = "distance_km", y: str = "mean_coherence", w: str = "n") -> str:
    """The same fit as DuckDB text over a table name."""
    model = MODELS[model] if isinstance(model, str) else model
    ks = "".join(f"{k}, " for k in keys)
    base = f"(SELECT {ks}cast({r} AS double) AS r, cast({y} AS double) AS y, cast({w} AS double) AS w FROM {bins} WHERE {r} IS NOT NULL AND {y} IS NOT NULL AND {w} > 0)"
    log_step = f"(ln({model.high / model.low!r}) / {GRID})"
    group = f"GROUP BY {', '.join(keys)}" if keys else ""

    def points(source: str) -> str:
        sums = f"(SELECT {ks}theta, {', '.join(f'{v} AS {k}' for k, v in SUMS.items())} FROM (SELECT *, {model.g('r', 'theta')} AS g FROM {source} q) p GROUP BY {ks}theta)"
        return f"(SELECT {ks}b.* FROM (SELECT {ks}min_by({{{', '.join(f'{x!r}: {x}' for x in BEST)}}}, wrss) AS b FROM {nest(sums, SOLVE)} m {group}) o)"

    best = points(f"(SELECT f.*, {model.low!r} * exp(k * {log_step}) AS theta FROM {base} f, range(0, {GRID + 1}) t(k))")
    for level in range(1, REFINE + 1):
        match = " AND ".join(f"f.{k} = c.{k}" for k in keys) or "true"
        near = f"(SELECT DISTINCT {ks}least({model.high!r}, greatest({model.low!r}, theta * exp(k * {log_step} / {HALF**level}))) AS theta FROM {best} z, range(-{HALF}, {HALF + 1}) t(k))"
        best = points(f"(SELECT f.*, c.theta FROM {base} f JOIN {near} c ON {match})")
    return f"(SELECT * FROM {nest(best, DIAGNOSE)} z WHERE n_bins >= 4)".replace("0.0D", "0.0")


def rank_models(fits: DataFrame, keys: list[str]) -> DataFrame:
    """Adds delta_aic and rank (1 for the least AIC) inside each group."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    return fits.withColumns({"delta_aic": F.col("aic") - F.min("aic").over(w), "rank": F.rank().over(w.orderBy("aic"))})


def fit_all(bins: DataFrame, keys: list[str], models: list[str | Model] | None = None, **names) -> DataFrame:
    """The fits of several models in one job, ranked."""
    return rank_models(fit_decay(bins, keys, models or ["exponential", "gaussian", "squared_exponential", "power_law", "matern_1_5", "matern_2_5"], **names), keys)


def harmonic_sums(phase: str, y: str) -> dict[str, str]:
    return {"h_n": "count(*)", "h_s": f"sum(sin({phase}))", "h_c": f"sum(cos({phase}))", "h_ss": f"sum(sin({phase}) * sin({phase}))", "h_cc": f"sum(cos({phase}) * cos({phase}))", "h_sc": f"sum(sin({phase}) * cos({phase}))", "h_y": f"sum({y})", "h_sy": f"sum(sin({phase}) * ({y}))", "h_cy": f"sum(cos({phase}) * ({y}))", "h_yy": f"sum(({y}) * ({y}))"}


#: y = p sin + q cos + m by the 3x3 normal equations.
HARMONIC: Steps = [
    {"u_ss": "h_ss - h_s * h_s / h_n", "u_cc": "h_cc - h_c * h_c / h_n", "u_sc": "h_sc - h_s * h_c / h_n", "u_sy": "h_sy - h_s * h_y / h_n", "u_cy": "h_cy - h_c * h_y / h_n", "u_yy": "h_yy - h_y * h_y / h_n"},
    {"u_det": "u_ss * u_cc - u_sc * u_sc"},
    {"p_sin": "CASE WHEN abs(u_det) > 1e-12 THEN (u_cc * u_sy - u_sc * u_cy) / u_det END", "q_cos": "CASE WHEN abs(u_det) > 1e-12 THEN (u_ss * u_cy - u_sc * u_sy) / u_det END"},
    {"amplitude": "sqrt(p_sin * p_sin + q_cos * q_cos)", "phase_shift": "atan2(q_cos, p_sin)", "level": "(h_y - p_sin * h_s - q_cos * h_c) / h_n", "r2": "CASE WHEN u_yy > 0 THEN (p_sin * u_sy + q_cos * u_cy) / u_yy END"},
]


def fit_harmonic(df: DataFrame, keys: list[str], phase: str, y: str) -> DataFrame:
    """amplitude * sin(phase + phase_shift) + level for each group, in closed form."""
    sums = df.groupBy(*keys).agg(*[F.expr(v).alias(k) for k, v in harmonic_sums(phase, y).items()])
    return apply(sums, HARMONIC).select(*keys, F.col("h_n").alias("n"), "amplitude", "phase_shift", "level", "r2")


def fit_harmonic_sql(source: str, keys: list[str], phase: str, y: str) -> str:
    ks = "".join(f"{k}, " for k in keys)
    sums = f"(SELECT {ks}{', '.join(f'{v} AS {k}' for k, v in harmonic_sums(phase, y).items())} FROM {source} z GROUP BY {', '.join(keys) or '()'})"
    return f"(SELECT {ks}h_n AS n, amplitude, phase_shift, level, r2 FROM {nest(sums, HARMONIC)} y)"


WAVELENGTHS = (500.0, 1000.0, 2000.0, 3000.0, 5000.0, 8000.0, 12_000.0)
WAVE = {"c": "cos(2 * pi() * r / wavelength) * exp(-r / (2 * wavelength))", "s": "sin(2 * pi() * r / wavelength) * exp(-r / (2 * wavelength))"}
WAVE_SUMS = {"h_n": "1", "h_c": "c", "h_s": "s", "h_cc": "c * c", "h_ss": "s * s", "h_sc": "s * c", "h_y": "y", "h_cy": "c * y", "h_sy": "s * y", "h_yy": "y * y"}


def fit_wave_sql(bins: str, keys: list[str], r: str = "distance_km", y: str = "mean_coherence", w: str = "n") -> str:
    """The same waves as `fit_wave`, as DuckDB text."""
    ks = ", ".join(keys)
    base = f"(SELECT {ks}, wavelength, cast({r} AS double) AS r, cast({y} AS double) AS y, cast({w} AS double) AS w FROM {bins} b, (VALUES {', '.join(f'({x!r}::double)' for x in WAVELENGTHS)}) t(wavelength))"
    sums = f"(SELECT {ks}, wavelength, {', '.join(f'sum(w * {x}) AS {k}' for k, x in WAVE_SUMS.items())}, count(*) AS n_bins FROM {nest(base, [WAVE])} g GROUP BY {ks}, wavelength)"
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {ks} ORDER BY r2 DESC, wavelength DESC) AS rk FROM {nest(sums, HARMONIC)} z WHERE r2 IS NOT NULL) y WHERE rk = 1)"


def fit_wave(bins: DataFrame, keys: list[str], r: str = "distance_km", y: str = "mean_coherence", w: str = "n", wavelengths: tuple[float, ...] = WAVELENGTHS) -> DataFrame:
    """Damped plane wave A cos(2 pi r / L + p) exp(-r / 2L) + C: linear in three terms for each wavelength L.

    The normal equations of each (group, L) are solved by Cramer's rule; the L of the highest weighted R2 wins.
    """
    base = bins.select(*keys, F.col(r).cast("double").alias("r"), F.col(y).cast("double").alias("y"), F.col(w).cast("double").alias("w"))
    grid = base.withColumn("wavelength", F.explode(F.array(*[F.lit(float(x)) for x in wavelengths])))
    grid = apply(grid, [WAVE])
    sums = grid.groupBy(*keys, "wavelength").agg(*[F.expr(f"sum(w * {x})").alias(k) for k, x in WAVE_SUMS.items()], F.count("*").alias("n_bins"))
    fitted = apply(sums, HARMONIC).where("r2 IS NOT NULL")
    return fitted.groupBy(*keys).agg(F.max_by(F.struct("wavelength", "amplitude", "phase_shift", "level", "r2", "n_bins"), F.struct("r2", "wavelength")).alias("b")).select(*keys, "b.*")


#: Sums and solution of a Gaussian peak at a grid point.
PEAK_SUMS = {"sw": "cast(count(*) AS double)", "sg": "sum(g)", "sgg": "sum(g * g)", "sy": "sum(y)", "sgy": "sum(g * y)", "syy": "sum(y * y)"}
PEAK: Steps = [
    {"det": "sw * sgg - sg * sg"},
    {"amplitude": "CASE WHEN det > 1e-9 THEN (sw * sgy - sg * sy) / det ELSE 0.0D END"},
    {"level": "(sy - amplitude * sg) / sw"},
    {"rss": "greatest(0.0D, syy - amplitude * sgy - level * sy)"},
    {"r2": "CASE WHEN syy - sy * sy / sw > 0 THEN 1 - rss / (syy - sy * sy / sw) END", "se_amplitude": "CASE WHEN det > 1e-9 AND sw > 4 THEN sqrt(rss / (sw - 4) * sw / det) END"},
]


def fit_peak_sql(series: str, keys: list[str], x: str, y: str, centres: list[float], widths: list[float]) -> str:
    """The same peaks as `fit_peak`, as DuckDB text."""
    ks = ", ".join(keys)
    values = lambda v: ", ".join(f"({e!r}::double)" for e in v)
    grid = f"(SELECT {ks}, centre, width, cast({y} AS double) AS y, exp(-pow(({x} - centre) / width, 2) / 2) AS g FROM {series} s, (VALUES {values(centres)}) a(centre), (VALUES {values(widths)}) b(width) WHERE {y} IS NOT NULL)"
    sums = f"(SELECT {ks}, centre, width, {', '.join(f'{v} AS {k}' for k, v in PEAK_SUMS.items())} FROM {grid} g GROUP BY {ks}, centre, width)"
    solved = nest(sums, PEAK).replace("0.0D", "0.0")
    return f"(SELECT *, cast(sw AS bigint) AS n FROM (SELECT *, row_number() OVER (PARTITION BY {ks} ORDER BY rss, centre, width) AS rk FROM {solved} z) y WHERE rk = 1)"


def fit_peak(series: DataFrame, keys: list[str], x: str, y: str, centres: list[float], widths: list[float]) -> DataFrame:
    """Gaussian peak A exp(-(x - m)^2 / 2 s^2) + C for each group, by a grid over (m, s)."""
    base = series.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("y IS NOT NULL")
    grid = base.withColumn("centre", F.explode(F.array(*[F.lit(float(v)) for v in centres]))).withColumn("width", F.explode(F.array(*[F.lit(float(v)) for v in widths])))
    grid = grid.withColumn("g", F.expr("exp(-pow((x - centre) / width, 2) / 2)"))
    sums = grid.groupBy(*keys, "centre", "width").agg(*[F.expr(v).alias(k) for k, v in PEAK_SUMS.items()])
    solved = apply(sums, PEAK)
    best = solved.groupBy(*keys).agg(F.min_by(F.struct("centre", "width", "amplitude", "level", "r2", "se_amplitude", F.col("sw").cast("long").alias("n")), F.struct("rss", "centre", "width")).alias("b")).select(*keys, "b.*")
    return best.withColumn("significant", F.expr("coalesce(abs(amplitude) > 2 * se_amplitude, false)"))
