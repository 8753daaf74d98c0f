"""Relative motion of a pair's ends as a sum of rotating vectors, and evidence classes: G14, G23, C8."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlag.functions import geo
from meshlag.operators.stats import p_of_r
from meshlag.operators.steps import Steps, apply, nest
from meshlag.plans.fixtures import PAIR_DAY_SQL, pair_day
from meshlag.plans.registry import query, r

DAY_S, RADIUS_M, WOBBLE_DAYS, TIDE_HOURS = 86_400.0, 6_371_000.0, 433.0, 12.42
SPIN = f"(2 * pi() / {DAY_S})"
#: Orbital speed (m/s) and radius (m), wobble amplitude (m), lunar tidal acceleration (m/s2).
ORBIT_SPEED, ORBIT_RADIUS, WOBBLE_M, TIDE = 29_780.0, 1.496e11, 9.0, 1.1e-6

_lat = {e: f"cos(radians(lat_{e}))" for e in "ij"}
_gap = lambda f: f"abs(({f('j')}) - ({f('i')}))"
#: Phase of each motion, and how much it differs between the two ends (m/s2).
PHASES = {"spin": "2 * pi() * (d % 1)", "orbit": geo.cycle_phase("d", 365.25), "wobble": geo.cycle_phase("d", WOBBLE_DAYS), "tide": f"2 * pi() * ((d * 24) % {TIDE_HOURS}) / {TIDE_HOURS}"}
AMOUNTS = {
    "spin": _gap(lambda e: f"{_lat[e]} * {SPIN} * {SPIN} * {RADIUS_M}"),
    "orbit": _gap(lambda e: f"cos(p_orbit + radians(lon_{e})) * {ORBIT_SPEED**2 / ORBIT_RADIUS!r}"),
    "wobble": _gap(lambda e: f"abs({_lat[e]}) * sin(p_wobble) * {WOBBLE_M} * pow(2 * pi() / {WOBBLE_DAYS * DAY_S}, 2)"),
    "tide": _gap(lambda e: f"{TIDE!r} * cos(p_tide + 2 * radians(lon_{e})) * {_lat[e]}"),
}
#: Length of each motion's vector: speed in km/s for the spin, mm/s2 for the orbit, m/s2 else.
LENGTHS = {"spin": _gap(lambda e: f"{_lat[e]} * {SPIN} * {RADIUS_M / 1000}"), "orbit": "a_orbit * 1000", "wobble": "a_wobble", "tide": "a_tide"}
ALIGNED = list(combinations(("spin", "orbit", "wobble"), 2))
LOCKED = [("spin", "orbit"), ("spin", "wobble"), ("orbit", "wobble"), ("tide", "spin")]
_all = lambda t, by=" + ": by.join(t.format(m=m) for m in PHASES)
_count = lambda test: " + ".join(f"CASE WHEN align_{a}_{b} {test} THEN 1 ELSE 0 END" for a, b in ALIGNED)
MOTION: Steps = [
    {f"p_{m}": x for m, x in PHASES.items()},
    {f"a_{m}": x for m, x in AMOUNTS.items()},
    {"total_acc": f"sqrt({_all('a_{m} * a_{m}')})", **{f"l_{m}": x for m, x in LENGTHS.items()}},
    {**{f"x_{m}": f"l_{m} * cos(p_{m})" for m in PHASES}, **{f"y_{m}": f"l_{m} * sin(p_{m})" for m in PHASES}},
    {"sum_x": _all("x_{m}"), "sum_y": _all("y_{m}"), **{f"align_{a}_{b}": f"(x_{a} * x_{b} + y_{a} * y_{b}) / (l_{a} * l_{b} + 1e-10)" for a, b in ALIGNED}, **{f"lock_{a}_{b}": f"cos(p_{a} - p_{b})" for a, b in LOCKED}, **{f"apart_{a}_{b}": f"abs(p_{a} - p_{b})" for a, b in LOCKED}},
    {"speed": "sqrt(sum_x * sum_x + sum_y * sum_y)", "heading": "atan2(sum_y, sum_x)", "in_step": " + ".join(f"abs(lock_{a}_{b})" for a, b in LOCKED), "with_": _count("> 0.5"), "against": _count("< -0.5")},
    {
        "oscillation": f"({_all('abs(x_{m})')}) / (speed + 1e-10)", "phase_coherence": "in_step / 4.0",
        "state": "CASE WHEN with_ >= 2 THEN 'constructive' WHEN against >= 2 THEN 'destructive' WHEN with_ = 1 AND against = 1 THEN 'mixed' ELSE 'neutral' END",
        "distance_class": "CASE WHEN dist_km < 1000 THEN 'short' WHEN dist_km < 5000 THEN 'medium' ELSE 'long' END", "projection": f"29.78 * abs(cos(radians({geo.azimuth('lat_i', 'lon_i', 'lat_j', 'lon_j')})))",
    },
    {"coupling": "(a_spin * align_spin_orbit + a_orbit * align_orbit_wobble + a_wobble * align_spin_wobble) * phase_coherence"},
]
_means = {"total_acc": 9, "speed": 6, "oscillation": 4, "phase_coherence": 6, "coupling": 10, "projection": 5, **{f"a_{m}": 12 for m in ("spin", "orbit", "tide")}, **{f"align_{a}_{b}": 5 for a, b in ALIGNED}, **{f"lock_{a}_{b}": 6 for a, b in LOCKED}, "apart_orbit_wobble": 6, "coherence": 6}
_states = {"n": "count(*)", **{f"mean_{k}": r(f"avg({k})", d) for k, d in _means.items()}, "r_coupling": r("corr(coupling, coherence)", 5)}


@query(f"SELECT distance_class, state, {', '.join(f'{v} AS {k}' for k, v in _states.items())} FROM {nest('(SELECT *, date_diff(' + chr(39) + 'day' + chr(39) + ', date ' + chr(39) + '2000-01-01' + chr(39) + ', date) AS d FROM ' + PAIR_DAY_SQL + ' p)', MOTION)} m GROUP BY 1, 2")
def relative_motion_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All motion columns of every pair row, summed up by distance class and state of interference."""
    m = apply(pair_day(spark, sf_dir).withColumn("d", F.datediff("date", F.lit("2000-01-01").cast("date"))), MOTION)
    return m.groupBy("distance_class", "state").agg(*[F.expr(v).alias(k) for k, v in _states.items()])


#: Least |r| and largest p of each class of evidence, by kind.
EVIDENCE = {
    "orbital": [("robust", 0.7, 0.001), ("strong", 0.5, 0.01), ("moderate", 0.3, 0.05), ("weak", 0.2, None)],
    "wobble": [("robust", 0.7, 0.001), ("significant", 0.5, 0.01), ("identified", 0.3, 0.05)],
    "nutation": [("robust", 0.8, 0.001), ("significant", 0.6, 0.01), ("identified", 0.4, 0.05)],
}


def evidence(kind: str, corr: str = "r", p: str = "p_value") -> str:
    """Class of a correlation by its size and p, the first that fits; `none` else."""
    tests = " ".join(f"WHEN abs({corr}) > {least}{f' AND {p} < {most}' if most else ''} THEN '{name}'" for name, least, most in EVIDENCE[kind])
    return f"CASE {tests} ELSE 'none' END"


CYCLES = {"orbital": 365.25, "wobble": 433.0, "nutation": 6798.0}


@query()
def evidence_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of each centre's daily coherence with the sine or cosine (the stronger) of three cycles, its p and class."""
    p = pair_day(spark, sf_dir, False)
    d = p.groupBy("center", F.datediff("date", F.lit("2000-01-01").cast("date")).alias("d")).agg(F.avg("coherence").alias("m"))
    out = None
    for kind, days in CYCLES.items():
        phase = geo.cycle_phase("d", days)
        c = d.groupBy("center").agg(F.count("*").alias("n"), F.expr(f"corr(m, sin({phase}))").alias("s"), F.expr(f"corr(m, cos({phase}))").alias("c"))
        one = c.select("center", F.lit(kind).alias("kind"), "n", F.expr("CASE WHEN abs(s) >= abs(c) THEN s ELSE c END").alias("r"))
        one = one.withColumn("p_value", p_of_r("r", F.col("n").cast("double"))).withColumn("evidence", F.expr(evidence(kind)))
        out = one if out is None else out.unionByName(one)
    return out
