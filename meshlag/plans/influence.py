"""Influence of bodies at a distance on the daily coherence: G20, C21."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlag.operators.stats import average_rank
from meshlag.plans.fixtures import DAILY_SQL, daily, read
from meshlag.plans.registry import query, r, select

#: Masses in Earth masses.
MASSES = {"sun": 332946.0, "jupiter": 317.8, "saturn": 95.2, "venus": 0.815, "mars": 0.107}
PLANETS = [b for b in MASSES if b != "sun"]
_body = "CASE substr(o_orderpriority, 1, 1) " + " ".join(f"WHEN '{k}' THEN '{b}'" for k, b in enumerate(MASSES, 1)) + " END"
_mass = "CASE body " + " ".join(f"WHEN '{b}' THEN {m}D" for b, m in MASSES.items()) + " END"


def ephemeris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, body, distance_au): a stand-in for an ephemeris table, from the orders of a day and priority."""
    o = read(spark, sf_dir, "orders").selectExpr("cast(o_orderdate AS date) AS date", f"{_body} AS body", "cast(round(o_totalprice * 100) AS bigint) AS c")
    return o.groupBy("date", "body").agg(F.expr("0.5D + cast(sum(c) % 1000 AS double) / 100").alias("distance_au"))


EPHEMERIS_SQL = f"(SELECT cast(o_orderdate AS date) AS date, {_body} AS body, 0.5::double + cast(cast(sum(cast(round(o_totalprice * 100) AS bigint)) AS bigint) % 1000 AS double) / 100 AS distance_au FROM orders GROUP BY 1, 2)"
_sums = {f"{b}_influence": f"sum(CASE WHEN body = '{b}' THEN influence END)" for b in MASSES}
_sums |= {"planetary_influence": "sum(CASE WHEN body <> 'sun' THEN influence END)", "total_influence": "sum(influence)", "bodies": "count(*)"}
INFLUENCE_SQL = f"(SELECT date, {', '.join(f'{v} AS {k}' for k, v in _sums.items())} FROM (SELECT date, body, {_mass} / (distance_au * distance_au) AS influence FROM {EPHEMERIS_SQL} e) q GROUP BY date)"


def influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mass over squared distance of each body and day, side by side, with the sums over planets and over all."""
    e = ephemeris(spark, sf_dir).withColumn("influence", F.expr(f"{_mass} / (distance_au * distance_au)"))
    return e.groupBy("date").agg(*[F.expr(v).alias(k) for k, v in _sums.items()])


_out = {"date": "date", **{k: k if k == "bodies" else r(k, 5 if k.endswith(("planetary_influence", "total_influence")) else 9) for k in _sums}}


@query(f"SELECT {', '.join(f'{v} AS {k}' for k, v in _out.items())} FROM {INFLUENCE_SQL} i")
def daily_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(influence(spark, sf_dir), _out)


SOURCES = [*[f"{b}_influence" for b in MASSES], "planetary_influence", "total_influence"]
_stack = f"stack({len(SOURCES)}, {', '.join(f'{chr(39)}{s}{chr(39)}, {s}' for s in SOURCES)}) AS (source, x)"
_long = " UNION ALL ".join(f"SELECT date, '{s}' AS source, {s} AS x FROM {INFLUENCE_SQL} i" for s in SOURCES)
_joined = f"(SELECT source, metric, round(x, 9) AS x, round(CASE metric WHEN 'mean' THEN m ELSE sd END, 9) AS y FROM ({_long}) l JOIN {DAILY_SQL} d ON d.date = l.date, (VALUES ('mean'), ('deviation')) t(metric) WHERE x IS NOT NULL)"
_rank = "rank() OVER (PARTITION BY source, metric ORDER BY {v}) + (count(*) OVER (PARTITION BY source, metric, {v}) - 1) / 2"


@query(f"SELECT source, metric, count(*) AS n, {r('corr(x, y)', 5)} AS pearson, {r('corr(rx, ry)', 5)} AS spearman FROM (SELECT *, {_rank.format(v='x')} AS rx, {_rank.format(v='y')} AS ry FROM {_joined} j) q GROUP BY 1, 2")
def influence_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each body's influence, the planets' and the total against the daily mean and deviation: product-moment and rank correlation."""
    d = daily(spark, sf_dir).join(influence(spark, sf_dir), "date").select("m", "sd", F.expr(_stack)).where("x IS NOT NULL")
    both = d.selectExpr("source", "round(x, 9) AS x", "stack(2, 'mean', round(m, 9), 'deviation', round(sd, 9)) AS (metric, y)")
    ranked = average_rank(average_rank(both, "x", "rx", ["source", "metric"]), "y", "ry", ["source", "metric"])
    return ranked.groupBy("source", "metric").agg(F.count("*").alias("n"), F.expr(r("corr(x, y)", 5)).alias("pearson"), F.expr(r("corr(rx, ry)", 5)).alias("spearman"))


_side = "CASE WHEN x > hi THEN 'peak' WHEN x < lo THEN 'valley' END"


@query(f"SELECT side, count(*) AS days, {r('avg(m)')} AS mean_coherence, {r('avg(sd)')} AS mean_deviation FROM (SELECT m, sd, {_side} AS side FROM (SELECT d.m, d.sd, i.planetary_influence AS x, quantile_cont(i.planetary_influence, 0.9) OVER () AS hi, quantile_cont(i.planetary_influence, 0.1) OVER () AS lo FROM {INFLUENCE_SQL} i JOIN {DAILY_SQL} d ON d.date = i.date WHERE i.planetary_influence IS NOT NULL) q) z WHERE side IS NOT NULL GROUP BY 1")
def influence_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coherence on the days of strongest and weakest planetary influence."""
    d = daily(spark, sf_dir).join(influence(spark, sf_dir), "date").select("m", "sd", F.col("planetary_influence").alias("x")).where("x IS NOT NULL")
    limits = d.agg(F.percentile("x", 0.9).alias("hi"), F.percentile("x", 0.1).alias("lo"))
    sided = d.join(F.broadcast(limits), F.lit(True)).withColumn("side", F.expr(_side)).where("side IS NOT NULL")  # one row
    return sided.groupBy("side").agg(F.count("*").alias("days"), F.expr(r("avg(m)")).alias("mean_coherence"), F.expr(r("avg(sd)")).alias("mean_deviation"))
