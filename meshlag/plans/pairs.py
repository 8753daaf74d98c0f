"""Pair rows: filters, lookups, grouped aggregates, top-k, sets, dedupe: P1-P18, J1-J12, A1-A31, L1-L9, U1-U5, W1-W6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlag.functions import geo
from meshlag.functions.bins import accumulate, bin_text, finalise
from meshlag.operators.stats import average_rank, weighted_percentile
from meshlag.plans.fixtures import EXTERNAL_SQL, PAIR_DAY_SQL, binned, clock, clock_sql, external_daily, pair_day, read
from meshlag.plans.registry import cols, query, r, select

BIN = bin_text("dist_km")
BINNED = f"(SELECT *, {BIN} AS bin FROM {PAIR_DAY_SQL} p WHERE dist_km > 0)"
AZ = f"round({geo.azimuth('lat_i', 'lon_i', 'lat_j', 'lon_j')}, 9)"


_bins = {"center": "center", "bin": "bin", "n": "n", "mean_coherence": r("s1 / n"), "std_coherence": r("sqrt(greatest(0.0D, s2 / n - (s1 / n) * (s1 / n)))"), "distance_km": r("sd / n", 4)}
STATES = f"(SELECT center, bin, sum(coherence) AS s1, sum(coherence * coherence) AS s2, sum(dist_km) AS sd, count(*) AS n FROM {BINNED} b WHERE bin BETWEEN 0 AND 39 GROUP BY center, bin)"


@query(f"SELECT {cols(_bins)} FROM {STATES} s WHERE n >= 50")
def distance_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(finalise(accumulate(binned(spark, sf_dir), ["center"])), _bins)


_pear = {"i": "i", "j": "j", "n": "n", "pearson": r("c")}


@query(f"SELECT {cols(_pear)} FROM (SELECT a.st AS i, b.st AS j, count(*) AS n, corr(a.bias, b.bias) AS c FROM {clock_sql(3600)} a JOIN {clock_sql(3600)} b ON a.e = b.e AND a.st < b.st GROUP BY 1, 2 HAVING count(*) >= 20) q")
def epoch_pair_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = clock(spark, sf_dir, 3600)
    enough = obs.groupBy("st").count().where("count >= 20").select("st")
    obs = obs.join(enough, "st", "left_semi")
    a, b = obs.select("e", F.col("st").alias("i"), F.col("bias").alias("x")), obs.select("e", F.col("st").alias("j"), F.col("bias").alias("y"))
    joined = a.join(b, "e").where("i < j").groupBy("i", "j").agg(F.count("*").alias("n"), F.corr("x", "y").alias("c")).where("n >= 20")
    return select(joined, _pear)


@query(f"SELECT st, count(*) AS n, {r('min(d)')} AS min_step, {r('max(d)')} AS max_step, {r('median(d)')} AS median_step, {r('quantile_cont(d, 0.1)')} AS p10_step, abs(quantile_cont(d, 0.1) - median(d)) <= 0.1 * median(d) AS regular FROM (SELECT st, cast(e - lag(e) OVER (PARTITION BY st ORDER BY e) AS double) AS d FROM {clock_sql(3600)} c) q GROUP BY st")
def epoch_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("st").orderBy("e")
    d = clock(spark, sf_dir, 3600).select("st", (F.col("e") - F.lag("e").over(w)).cast("double").alias("d"))
    return d.groupBy("st").agg(F.count("*").alias("n"), F.expr(r("min(d)")).alias("min_step"), F.expr(r("max(d)")).alias("max_step"), F.expr(r("percentile(d, 0.5)")).alias("median_step"), F.expr(r("percentile(d, 0.1)")).alias("p10_step"), F.expr("abs(percentile(d, 0.1) - percentile(d, 0.5)) <= 0.1 * percentile(d, 0.5)").alias("regular"))


@query(f"SELECT {geo.sector(AZ)} AS sector, {geo.compass_class(AZ)} AS compass, count(*) AS n, {r('avg(coherence)')} AS mean_coherence, {r('stddev_samp(coherence)')} AS sd FROM {PAIR_DAY_SQL} p GROUP BY 1, 2")
def directional_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair_day(spark, sf_dir).selectExpr("coherence", f"{geo.sector(AZ)} AS sector", f"{geo.compass_class(AZ)} AS compass")
    return p.groupBy("sector", "compass").agg(F.count("*").alias("n"), F.expr(r("avg(coherence)")).alias("mean_coherence"), F.expr(r("stddev_samp(coherence)")).alias("sd"))


_reg = geo.region(f"round({geo.middle_longitude('lon_i', 'lon_j')}, 6)")
_sig = {"n": "count(*)", "mean_coherence": r("avg(coherence)"), "sd": r("stddev_pop(coherence)"), "strong_share": r("avg(CASE WHEN coherence > 0.1 THEN 1.0D ELSE 0.0D END)"), "weighted_mean": r("sum(coherence / (dist_km + 100)) / sum(1 / (dist_km + 100))"), "longitude_centre": r("avg((lon_i + lon_j) / 2)", 4), "latitude_centre": r("avg((lat_i + lat_j) / 2)", 4)}


@query(f"SELECT {_reg} AS region, {cols(_sig)} FROM {PAIR_DAY_SQL} p GROUP BY 1 HAVING count(*) >= 50")
def regional_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair_day(spark, sf_dir).withColumn("region", F.expr(_reg))
    return p.groupBy("region").agg(*[F.expr(v).alias(k) for k, v in _sig.items()]).where("n >= 50")


_nf = {"near_n": "cast(sum(CASE WHEN dist_km <= 5000 THEN 1 ELSE 0 END) AS bigint)", "far_n": "cast(sum(CASE WHEN dist_km > 5000 THEN 1 ELSE 0 END) AS bigint)", "near_mean": r("avg(CASE WHEN dist_km <= 5000 THEN coherence END)"), "far_mean": r("avg(CASE WHEN dist_km > 5000 THEN coherence END)"), "short_mean": r("avg(CASE WHEN dist_km < 2000 THEN coherence END)")}


@query(f"SELECT center, {cols(_nf)} FROM {PAIR_DAY_SQL} p GROUP BY center")
def near_far_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_day(spark, sf_dir).groupBy("center").agg(*[F.expr(v).alias(k) for k, v in _nf.items()])


@query(f"SELECT center, count(DISTINCT date) AS days, count(DISTINCT i * 100 + j) AS pairs, (SELECT count(DISTINCT s) FROM (SELECT center AS c2, i AS s FROM {PAIR_DAY_SQL} x UNION ALL SELECT center, j FROM {PAIR_DAY_SQL} y) u WHERE u.c2 = p.center) AS stations FROM {PAIR_DAY_SQL} p GROUP BY center")
def coverage_by_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair_day(spark, sf_dir)
    counts = p.groupBy("center").agg(F.countDistinct("date").alias("days"), F.countDistinct(F.col("i") * 100 + F.col("j")).alias("pairs"))
    stations = p.select("center", F.explode(F.array("i", "j")).alias("s")).groupBy("center").agg(F.countDistinct("s").alias("stations"))
    return counts.join(stations, "center")


@query(f"SELECT cast(floor((dist_km - 0) / 200) AS int) AS bucket, center, count(*) AS n FROM {PAIR_DAY_SQL} p GROUP BY 1, 2")
def distance_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_day(spark, sf_dir).groupBy(F.floor(F.col("dist_km") / 200).cast("int").alias("bucket"), "center").agg(F.count("*").alias("n"))


_equal = "cast(least(99, floor((dist_km - lo) / (hi - lo) * 100)) AS int)"


@query(f"SELECT center, {_equal} AS bucket, count(*) AS n FROM (SELECT center, round(dist_km, 6) AS dist_km, min(round(dist_km, 6)) OVER () AS lo, max(round(dist_km, 6)) OVER () AS hi FROM {PAIR_DAY_SQL} p) q GROUP BY 1, 2")
def equal_bin_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred equal bins from the shortest to the longest distance."""
    p = pair_day(spark, sf_dir).groupBy("center", F.round("dist_km", 6).alias("dist_km")).agg(F.count("*").alias("n"))
    ends = p.agg(F.min("dist_km").alias("lo"), F.max("dist_km").alias("hi"))
    return p.join(F.broadcast(ends), F.lit(True)).groupBy("center", F.expr(_equal).alias("bucket")).agg(F.sum("n").alias("n"))  # one row


_third = "CASE WHEN d < 833 THEN 'before' WHEN d < 1666 THEN 'during' ELSE 'after' END"


@query(f"SELECT center, phase, count(*) AS months, {r('avg(sd)')} AS mean_sd, {r('max(sd) / min(sd)', 4)} AS spread FROM (SELECT center, {_third} AS phase, year(date) * 12 + month(date) AS month, stddev_samp(coherence) AS sd FROM (SELECT *, date_diff('day', date '1995-01-01', date) AS d FROM {PAIR_DAY_SQL} p) q GROUP BY 1, 2, 3 HAVING count(*) >= 10) z GROUP BY 1, 2")
def variability_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly deviation before, during and after the middle of the series."""
    p = pair_day(spark, sf_dir, False).withColumn("d", F.datediff("date", F.lit("1995-01-01").cast("date")))
    monthly = p.groupBy("center", F.expr(_third).alias("phase"), (F.year("date") * 12 + F.month("date")).alias("month")).agg(F.stddev_samp("coherence").alias("sd"), F.count("*").alias("n")).where("n >= 10")
    return monthly.groupBy("center", "phase").agg(F.count("*").alias("months"), F.expr(r("avg(sd)")).alias("mean_sd"), F.expr(r("max(sd) / min(sd)", 4)).alias("spread"))


_gap = geo.longitude_gap("lon_i", "lon_j")


@query(f"SELECT cast(floor(dist_km / 1000) AS int) AS bx, cast(floor({_gap} / 20) AS int) AS byy, count(*) AS n, {r('avg(coherence)')} AS mean_coherence FROM {PAIR_DAY_SQL} p GROUP BY 1, 2")
def distance_longitude_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair_day(spark, sf_dir).selectExpr("coherence", "cast(floor(dist_km / 1000) AS int) AS bx", f"cast(floor({_gap} / 20) AS int) AS byy")
    return p.groupBy("bx", "byy").agg(F.count("*").alias("n"), F.expr(r("avg(coherence)")).alias("mean_coherence"))


_score = f"CASE WHEN dist_km BETWEEN 3000 AND 4500 THEN 3 * coherence WHEN coherence > 0.8 THEN 2 * coherence ELSE 0.0D END + CASE WHEN abs(lat_i - lat_j) > 30 OR {_gap} > 60 THEN 0.5D ELSE 0.0D END"


@query(f"SELECT row, i, j, {r('coherence')} AS coherence, {r('score')} AS score FROM (SELECT *, {_score} AS score FROM {PAIR_DAY_SQL} p WHERE coherence > 0.5) q ORDER BY round(score, 9) DESC, row LIMIT 100")
def top_scored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair_day(spark, sf_dir).where("coherence > 0.5").withColumn("score", F.expr(_score))
    return select(p.orderBy(F.round("score", 9).desc(), "row").limit(100), {"row": "row", "i": "i", "j": "j", "coherence": r("coherence"), "score": r("score")})


_orient = "CASE WHEN abs(abs(lat_j - lat_i) - abs(lon_j - lon_i)) < 10 THEN 'diagonal' WHEN abs(lat_j - lat_i) > abs(lon_j - lon_i) THEN 'north_south' ELSE 'east_west' END"


@query(f"SELECT {_orient} AS orientation, count(*) AS n, cast(sum(CASE WHEN coherence > 0.8 THEN 1 ELSE 0 END) AS bigint) AS strong, {r('avg(abs(lon_j - lon_i))', 4)} AS mean_lon_gap FROM {PAIR_DAY_SQL} p GROUP BY 1")
def connection_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair_day(spark, sf_dir).withColumn("orientation", F.expr(_orient))
    return p.groupBy("orientation").agg(F.count("*").alias("n"), F.sum(F.when(F.col("coherence") > 0.8, 1).otherwise(0)).alias("strong"), F.expr(r("avg(abs(lon_j - lon_i))", 4)).alias("mean_lon_gap"))


@query(f"SELECT center, s, n FROM (SELECT center, s, count(*) AS n, row_number() OVER (PARTITION BY center ORDER BY count(*) DESC, s) AS k FROM (SELECT center, i AS s FROM {PAIR_DAY_SQL} x UNION ALL SELECT center, j FROM {PAIR_DAY_SQL} y) u GROUP BY center, s) q WHERE k <= 10")
def top_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = pair_day(spark, sf_dir, False).select("center", F.explode(F.array("i", "j")).alias("s")).groupBy("center", "s").agg(F.count("*").alias("n"))
    return n.withColumn("k", F.row_number().over(Window.partitionBy("center").orderBy(F.desc("n"), "s"))).where("k <= 10").drop("k")


@query(f"SELECT date, i, j FROM (SELECT date, i, j, row_number() OVER (PARTITION BY date ORDER BY md5(i || '#' || j || '#42'), i, j) AS k FROM (SELECT DISTINCT date, i, j FROM {PAIR_DAY_SQL} p) d) q WHERE k <= 5")
def hashed_pair_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair_day(spark, sf_dir).select("date", "i", "j").distinct()
    w = Window.partitionBy("date").orderBy(F.md5(F.concat_ws("#", F.col("i").cast("string"), F.col("j").cast("string"), F.lit("42"))), "i", "j")
    return p.withColumn("k", F.row_number().over(w)).where("k <= 5").drop("k")


@query(f"SELECT date, i, j, row FROM (SELECT *, row_number() OVER (PARTITION BY date, i, j ORDER BY row) AS k FROM {PAIR_DAY_SQL} p) q WHERE k = 1")
def first_pair_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair_day(spark, sf_dir, False)
    return p.groupBy("date", "i", "j").agg(F.min("row").alias("row"))


@query(f"SELECT date, i, j, {r('avg(coherence)')} AS coherence, count(*) AS n FROM {PAIR_DAY_SQL} p GROUP BY date, i, j")
def merged_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres are rows of one table, so any number of them merges in one scan."""
    return pair_day(spark, sf_dir, False).groupBy("date", "i", "j").agg(F.expr(r("avg(coherence)")).alias("coherence"), F.count("*").alias("n"))


_quiet = "coalesce(kp_index, 0) < 4 AND coalesce(ap_index, 0) < 20 AND coalesce(f107_flux, 100) < 200"


@query(f"SELECT {_quiet} AS quiet, p.center, count(*) AS n, {r('avg(p.coherence)')} AS mean_coherence FROM {PAIR_DAY_SQL} p LEFT JOIN {EXTERNAL_SQL} x ON x.date = p.date GROUP BY 1, 2")
def quiet_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair_day(spark, sf_dir, False).join(external_daily(spark, sf_dir), "date", "left")
    return p.groupBy(F.expr(_quiet).alias("quiet"), "center").agg(F.count("*").alias("n"), F.expr(r("avg(coherence)")).alias("mean_coherence"))


_box = "lat_{e} BETWEEN 0 AND 40 AND lon_{e} BETWEEN -60 AND 60"


@query(f"SELECT center, count(*) AS n, {r('avg(coherence)')} AS mean_coherence FROM {PAIR_DAY_SQL} p WHERE NOT ({_box.format(e='i')}) AND NOT ({_box.format(e='j')}) GROUP BY center")
def regional_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair_day(spark, sf_dir).where(f"NOT ({_box.format(e='i')}) AND NOT ({_box.format(e='j')})")
    return p.groupBy("center").agg(F.count("*").alias("n"), F.expr(r("avg(coherence)")).alias("mean_coherence"))


@query("SELECT l_returnflag AS center, count(*) AS n FROM lineitem l WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_suppkey) AND EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p.p_size <= 25) AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'F') GROUP BY 1")
def known_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    p = read(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"))
    o = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    kept = l.join(s, "l_suppkey", "left_semi").join(p, "l_partkey", "left_semi").join(o, "l_orderkey", "left_anti")
    return kept.groupBy(F.col("l_returnflag").alias("center")).agg(F.count("*").alias("n"))


@query(f"SELECT center, year(date) * 12 + month(date) AS month, count(*) AS n, {r('avg(coherence)')} AS mean_coherence, {r('stddev_samp(coherence)')} AS coherence_std, {r('median(coherence)', 5)} AS median_coherence FROM {PAIR_DAY_SQL} p GROUP BY 1, 2")
def monthly_variability(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair_day(spark, sf_dir, False)
    return p.groupBy("center", (F.year("date") * 12 + F.month("date")).alias("month")).agg(F.count("*").alias("n"), F.expr(r("avg(coherence)")).alias("mean_coherence"), F.expr(r("stddev_samp(coherence)")).alias("coherence_std"), F.expr(r("percentile(coherence, 0.5)", 5)).alias("median_coherence"))


@query(f"SELECT center, {r('min(v)')} AS p75 FROM (SELECT center, round(coherence, 9) AS v, sum(dist_km) OVER (PARTITION BY center ORDER BY round(coherence, 9) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c, sum(dist_km) OVER (PARTITION BY center) AS t FROM {PAIR_DAY_SQL} p) q WHERE c >= 0.75 * t GROUP BY center")
def weighted_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair_day(spark, sf_dir).withColumn("v", F.round("coherence", 9))
    return select(weighted_percentile(p, ["center"], "v", "dist_km", 0.75), {"center": "center", "p75": r("percentile")})


@query(f"SELECT center, {r('corr(ra, rb)')} AS spearman FROM (SELECT center, rank() OVER (PARTITION BY center ORDER BY a) + (count(*) OVER (PARTITION BY center, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY center ORDER BY b) + (count(*) OVER (PARTITION BY center, b) - 1) / 2 AS rb FROM (SELECT center, round(avg(coherence), 9) AS a, round(avg(dist_km), 6) AS b FROM {PAIR_DAY_SQL} p GROUP BY center, i, j) q) z GROUP BY center")
def spearman_by_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair_day(spark, sf_dir).groupBy("center", "i", "j").agg(F.round(F.avg("coherence"), 9).alias("a"), F.round(F.avg("dist_km"), 6).alias("b"))
    ranked = average_rank(average_rank(p, "a", "ra", ["center"]), "b", "rb", ["center"])
    return ranked.groupBy("center").agg(F.expr(r("corr(ra, rb)")).alias("spearman"))


_se = "sqrt((regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) / (regr_count(y, x) - 2) / regr_sxx(y, x))"
_trend = {"n": "regr_count(y, x)", "slope": r("regr_slope(y, x)", 8), "intercept": r("regr_intercept(y, x)"), "r2": r("regr_r2(y, x)"), "se_slope": r(_se, 8), "t_stat": r(f"regr_slope(y, x) / {_se}", 4)}


@query(f"SELECT center, {cols(_trend)} FROM (SELECT center, (h_i + h_j) / 2000 AS x, coherence AS y FROM {PAIR_DAY_SQL} p) q GROUP BY center")
def height_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_day(spark, sf_dir).selectExpr("center", "(h_i + h_j) / 2000 AS x", "coherence AS y").groupBy("center").agg(*[F.expr(v).alias(k) for k, v in _trend.items()])


_circ = {"n": "n", "locking": r("rr"), "direction": r("dir", 5), "rayleigh_p": r("exp(sqrt(1 + 4 * n + 4 * (cast(n AS double) * n - (n * rr) * (n * rr))) - (1 + 2 * n))")}


@query(f"SELECT bin, {cols(_circ)} FROM (SELECT bin, count(*) AS n, sqrt(pow(avg(cos(phase)), 2) + pow(avg(sin(phase)), 2)) AS rr, atan2(avg(sin(phase)), avg(cos(phase))) AS dir FROM {BINNED} b WHERE bin BETWEEN 0 AND 39 GROUP BY bin) q WHERE n >= 50")
def circular_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = binned(spark, sf_dir).groupBy("bin").agg(F.count("*").alias("n"), F.expr("sqrt(pow(avg(cos(phase)), 2) + pow(avg(sin(phase)), 2))").alias("rr"), F.expr("atan2(avg(sin(phase)), avg(cos(phase)))").alias("dir")).where("n >= 50")
    return select(b, {"bin": "bin", **_circ})


@query(f"SELECT date, {r('atan2(sum(abs(coherence) * sin(phase)), sum(abs(coherence) * cos(phase)))', 5)} AS mean_phase, {r('sqrt(pow(sum(abs(coherence) * sin(phase)), 2) + pow(sum(abs(coherence) * cos(phase)), 2)) / sum(abs(coherence))')} AS concentration FROM {PAIR_DAY_SQL} p GROUP BY date")
def weighted_circular_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_day(spark, sf_dir, False).groupBy("date").agg(F.expr(r("atan2(sum(abs(coherence) * sin(phase)), sum(abs(coherence) * cos(phase)))", 5)).alias("mean_phase"), F.expr(r("sqrt(pow(sum(abs(coherence) * sin(phase)), 2) + pow(sum(abs(coherence) * cos(phase)), 2)) / sum(abs(coherence))")).alias("concentration"))


@query(f"SELECT i AS s FROM {PAIR_DAY_SQL} a WHERE center = 'A' AND dist_km < 3000 INTERSECT SELECT j FROM {PAIR_DAY_SQL} b WHERE center = 'R' AND dist_km < 3000 EXCEPT SELECT i FROM {PAIR_DAY_SQL} c WHERE dist_km > 19500")
def station_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair_day(spark, sf_dir)
    a = p.where("center = 'A' AND dist_km < 3000").select(F.col("i").alias("s"))
    b = p.where("center = 'R' AND dist_km < 3000").select(F.col("j").alias("s"))
    return a.intersect(b).subtract(p.where("dist_km > 19500").select(F.col("i").alias("s")))


@query(f"SELECT center, {r('max(n) * 1.0 / sum(n)')} AS dominance, cast(min(s) FILTER (WHERE k = 1) AS bigint) AS mode_station FROM (SELECT center, s, n, row_number() OVER (PARTITION BY center ORDER BY n DESC, s) AS k FROM (SELECT center, i AS s, count(*) AS n FROM {PAIR_DAY_SQL} p GROUP BY 1, 2) q) z GROUP BY center")
def dominant_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = pair_day(spark, sf_dir, False).groupBy("center", F.col("i").alias("s")).agg(F.count("*").alias("n"))
    return n.groupBy("center").agg(F.expr(r("max(n) * 1.0D / sum(n)")).alias("dominance"), F.max_by("s", F.struct(F.col("n"), -F.col("s"))).alias("mode_station"))
