"""The network as a whole, week by week, and as a graph: C8, C9, C22, D15, G23, A12, A13, W6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlag.functions.cut import cut
from meshlag.operators import network
from meshlag.operators.series import wrapped_step
from meshlag.operators.stats import p_of_r
from meshlag.operators.steps import apply, nest
from meshlag.plans.events import _beats, beat_table
from meshlag.plans.fixtures import PAIR_DAY_SQL, pair_day
from meshlag.plans.motion import MOTION
from meshlag.plans.registry import query, r, select

#: Rows that a week must have; days of the year, of the wobble, of one and of half a turn.
LEAST_ROWS, CYCLES, TURNS = 8, (365.25, 427.0, 1.0, 0.5), (1.0, 365.25, 427.0)
STATES = ("constructive", "destructive", "mixed", "neutral")
_share = {s: f"sum(CASE WHEN state = '{s}' THEN 1 ELSE 0 END)" for s in STATES}
_even = lambda c: f"1 / (1 + stddev_samp({c}))"
_weekly = {
    "n": "count(*)", "magnitude": "avg(speed)", "direction": "avg(heading)", "uniformity": _even("coherence"), "in_phase": _even("phase_coherence"), "in_swing": _even("oscillation"), **_share,
}
_top = f"greatest({', '.join(STATES)})"
_scored = {"score": "(uniformity + in_phase + in_swing) / 3", "dominant": f"CASE {' '.join(f'WHEN {s} = {_top} THEN {chr(39)}{s}{chr(39)}' for s in STATES)} END", "dominance": f"cast({_top} AS double) / n"}
_moved = nest(f"(SELECT *, date_diff('day', date '2000-01-01', date) AS d FROM {PAIR_DAY_SQL} p)", MOTION)
WEEKS = f"(SELECT *, {', '.join(f'{v} AS {k}' for k, v in _scored.items())} FROM (SELECT center, cast(floor(d / 7.0) * 7 AS bigint) AS day, {', '.join(f'{v} AS {k}' for k, v in _weekly.items())} FROM {_moved} m GROUP BY 1, 2) w WHERE n >= {LEAST_ROWS})"


def weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all pairs of a centre do together in each week; one pass over the pair rows."""
    m = apply(pair_day(spark, sf_dir).withColumn("d", F.datediff("date", F.lit("2000-01-01").cast("date"))), MOTION)
    by = m.groupBy("center", (F.floor(F.col("d") / 7) * 7).cast("long").alias("day")).agg(*[F.expr(v).alias(k) for k, v in _weekly.items()]).where(F.col("n") >= LEAST_ROWS)
    return by.withColumns({k: F.expr(v) for k, v in _scored.items()})


_evolution = {"center": "center", "day": "day", "n": "n", "magnitude": r("magnitude"), "direction": r("direction", 5), "uniformity": r("uniformity"), "in_phase": r("in_phase"), "in_swing": r("in_swing", 5), "score": r("score", 5), "dominant": "dominant", "dominance": r("dominance")}


@query(f"SELECT {', '.join(f'{v} AS {k}' for k, v in _evolution.items())} FROM {WEEKS} w")
def network_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly vector of the motion, evenness of coherence, phases and swings, and the commonest state of interference."""
    return select(weeks(spark, sf_dir), _evolution)


LAGS = 60
_auto = {"center": "center", "lag": "cast(lag AS bigint)", "r": r("r", 5), "n": "n"}


@query(f"SELECT {', '.join(f'{v} AS {k}' for k, v in _auto.items())} FROM {network.autocorrelation_sql('(SELECT center, day // 7 AS week, score FROM ' + WEEKS + ' w)', 'center', 'week', 'score', LAGS)} a")
def network_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of a centre's weekly score with that of each of the following sixty weeks."""
    w = cut(weeks(spark, sf_dir).select("center", F.expr("day DIV 7").alias("week"), "score"))
    return select(network.autocorrelation(w, ["center"], "week", "score", LAGS), _auto)


_cycle = {"center": "center", "period": "period", "n": "n", "r": r("r", 5), "component": "component"}
_cycles = f"(SELECT *, {network.p_of_r_sql('r', 'n')} AS p FROM {network.cycles_sql(WEEKS, 'center', 'day', 'score', CYCLES)} c)"


def cycles_with_p(rows: DataFrame, keys: list[str], day: str, y: str, periods: tuple[float, ...]) -> DataFrame:
    c = network.cycles(rows, keys, day, y, periods)
    return c.withColumn("p", p_of_r(F.col("r"), F.col("n").cast("double")))


@query(f"SELECT {', '.join(f'{v} AS {k}' for k, v in _cycle.items())}, {r('p', 5)} AS p_value FROM {_cycles} c")
def network_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the weekly score follows the year, the wobble and the day; a cycle that weeks can't see has no r."""
    return select(cycles_with_p(weeks(spark, sf_dir), ["center"], "day", "score", CYCLES), {**_cycle, "p_value": r("p", 5)})


#: A steady turn, a swinging length, a cycle that counts, the shares of the four findings in the composite.
STEADY, SWING, COUPLED, P, SHARES = 0.3, 0.1, 0.3, 0.05, (0.3, 0.3, 0.2, 0.2)
_turns = {"weeks": "count(*)", "span_days": "max(day) - min(day)", "strength": "avg(score)", "turn": "avg(turn)", "steady": "1 - stddev_pop(turn) / (pi() / 4)", "swing": "CASE WHEN avg(magnitude) > 0 THEN stddev_pop(magnitude) / avg(magnitude) ELSE 0 END"}
_found = {"oscillations": f"sum(CASE WHEN p < {P} THEN 1 ELSE 0 END)", "best_r": f"max(CASE WHEN p < {P} THEN abs(r) END)", "couplings": f"sum(CASE WHEN p < {P} AND abs(r) > {COUPLED} AND period IN {TURNS} THEN 1 ELSE 0 END)"}
_spiral = {"spiral": f"steady > {STEADY} AND swing > {SWING}", "spiral_strength": "greatest(0, steady) * swing"}
_composite = {"composite": f"strength * {SHARES[0]} + CASE WHEN spiral THEN {SHARES[1]} ELSE 0 END + CASE WHEN oscillations > 0 THEN {SHARES[2]} ELSE 0 END + CASE WHEN couplings > 0 THEN {SHARES[3]} ELSE 0 END"}
#: Least composite of each class, and what must have been found.
CLASSES = [("exceptional", 0.8, "spiral AND couplings > 0"), ("strong", 0.6, "(spiral OR oscillations > 0)"), ("moderate", 0.4, "strength > 0.5"), ("weak", 0.2, "true")]
network_class = "CASE " + " ".join(f"WHEN composite >= {least} AND {need} THEN '{name}'" for name, least, need in CLASSES) + " ELSE 'none' END"
_steps = [_spiral, _composite, {"class": network_class}]
_report = {
    "center": "center", "weeks": "weeks", "span_days": "cast(span_days AS bigint)", "strength": r("strength", 5), "turn": r("turn", 4), "steady": r("greatest(0, steady)", 4), "swing": r("swing", 5), "spiral_strength": r("spiral_strength", 5), "spiral": "spiral",
    "oscillations": "cast(oscillations AS bigint)", "best_r": r("best_r", 5), "couplings": "cast(couplings AS bigint)", "composite": r("composite", 5), "class": "class",
}
_turned = f"(SELECT *, (x + pi()) - 2 * pi() * floor((x + pi()) / (2 * pi())) - pi() AS turn FROM (SELECT *, direction - lag(direction) OVER (PARTITION BY center ORDER BY day) AS x FROM {WEEKS} w) z)"


@query(f"""SELECT {', '.join(f'{v} AS "{k}"' for k, v in _report.items())} FROM {nest(f"(SELECT a.*, b.* EXCLUDE (center) FROM (SELECT center, {', '.join(f'{v} AS {k}' for k, v in _turns.items())} FROM {_turned} t GROUP BY 1) a JOIN (SELECT center, {', '.join(f'{v} AS {k}' for k, v in _found.items())} FROM {_cycles} c GROUP BY 1) b ON a.center = b.center)", _steps)} f""")
def network_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turning of the network's motion, its cycles, a composite of four findings and the class of evidence, for each centre."""
    w = cut(weeks(spark, sf_dir).select("center", "day", "direction", "magnitude", "score"))
    turned = wrapped_step(w, ["center"], "day", "direction").groupBy("center").agg(*[F.expr(v).alias(k) for k, v in _turns.items()])
    found = cycles_with_p(w, ["center"], "day", "score", CYCLES).groupBy("center").agg(*[F.expr(v).alias(k) for k, v in _found.items()])
    return select(apply(turned.join(found, "center"), _steps), _report)


_edges = f"(SELECT center, i, j FROM {PAIR_DAY_SQL} p GROUP BY 1, 2, 3 HAVING round(avg(coherence), 9) > 0)"
_graph = {"center": "center", "station": "node", "degree": "degree", "triangles": "triangles", "clustering": r("clustering")}


@query(f"SELECT {', '.join(f'{v} AS {k}' for k, v in _graph.items())} FROM {network.clustering_sql(_edges, 'center')} g")
def network_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of pairs that agree on average: neighbours, triangles and clustering of each station."""
    edges = pair_day(spark, sf_dir, False).groupBy("center", "i", "j").agg(F.avg("coherence").alias("c")).where("round(c, 9) > 0")
    return select(network.clustering(edges, ["center"]), _graph)


_class = "CASE WHEN dist_km < 1000 THEN 'short' WHEN dist_km < 5000 THEN 'medium' ELSE 'long' END"
#: Least significant beats and least of the strongest |r| of each class.
BEATS = [("robust", 3, 0.5), ("significant", 2, 0.3), ("detected", 1, 0.0)]
_beat = {"distance_class": "distance_class", "period": "period", "n": "n", "r": r("rr", 5), "component": "CASE WHEN abs(s) > abs(c) THEN 'sine' ELSE 'cosine' END", "p_value": r("p", 5)}
_daily = f"(SELECT {_class} AS distance_class, date_diff('day', date '2000-01-01', date) AS d, avg(coherence) AS m FROM {PAIR_DAY_SQL} p GROUP BY 1, 2)"
_wave = lambda f: f"corr(m, {f}(2 * pi() * ((d / period) % 1)))"
_tried = f"(SELECT *, {network.p_of_r_sql('rr', 'n')} AS p FROM (SELECT *, CASE WHEN abs(s) > abs(c) THEN s ELSE c END AS rr FROM (SELECT distance_class, period, count(*) AS n, {_wave('sin')} AS s, {_wave('cos')} AS c FROM {_daily} d, {_beats} b GROUP BY 1, 2) q) z)"


def beats_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(distance_class, period, n, s, c, rr, p): correlation of a class's daily coherence with each beat of the motions."""
    days = pair_day(spark, sf_dir).groupBy(F.expr(_class).alias("distance_class"), F.datediff("date", F.lit("2000-01-01").cast("date")).alias("d")).agg(F.avg("coherence").alias("m"))
    rows = days.join(F.broadcast(beat_table(spark, sf_dir).select("period").distinct()), F.lit(True))  # a dozen beats
    sums = rows.groupBy("distance_class", "period").agg(F.count("*").alias("n"), F.expr(_wave("sin")).alias("s"), F.expr(_wave("cos")).alias("c"))
    return sums.withColumn("rr", F.expr("CASE WHEN abs(s) > abs(c) THEN s ELSE c END")).withColumn("p", p_of_r(F.col("rr"), F.col("n").cast("double")))


@query(f"SELECT {', '.join(f'{v} AS {k}' for k, v in _beat.items())} FROM {_tried} t")
def relative_motion_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats of the motions in the coherence of near, middling and far pairs."""
    return select(beats_by_class(spark, sf_dir), _beat)


_verdict = {"tested": "count(*)", "successful": "count(rr)", "significant": f"sum(CASE WHEN p < {P} THEN 1 ELSE 0 END)", "strongest": f"coalesce(max(CASE WHEN p < {P} THEN abs(rr) END), 0)"}
relative_class = "CASE " + " ".join(f"WHEN significant >= {least} AND strongest >= {size} THEN '{name}'" for name, least, size in BEATS) + " WHEN successful > 0 THEN 'analysed' WHEN tested > 0 THEN 'evaluated' ELSE 'none' END"
_relative = {"tested": "tested", "successful": "successful", "significant": "cast(significant AS bigint)", "strongest": r("strongest", 5), "evidence": relative_class}


@query(f"SELECT {', '.join(f'{v} AS {k}' for k, v in _relative.items())} FROM (SELECT {', '.join(f'{v} AS {k}' for k, v in _verdict.items())} FROM {_tried} t) v")
def relative_motion_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of all beats of all distance classes in one class."""
    return select(beats_by_class(spark, sf_dir).agg(*[F.expr(v).alias(k) for k, v in _verdict.items()]), _relative)
