"""Leave-out, cross-validation, jackknife, bootstrap and nulls: R1-R20, N1-N5, N7-N9, C19, C26, C27."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlag.config import DEFAULT
from meshlag.functions import geo
from meshlag.functions.bins import accumulate, distance_bin, finalise
from meshlag.functions.cut import cut, small
from meshlag.operators import fit, resample, stats
from meshlag.plans.decay import bins, bins_sql, fits_of, fits_text
from meshlag.plans.fixtures import PAIR_DAY_SQL, STATION_SQL, binned, pair_day, pair_places, station
from meshlag.plans.pairs import BINNED
from meshlag.plans.registry import query, r, select
from meshlag.sources.tables import write_by_station

_state = {"n": "n", "mean_coherence": r("s1 / n"), "distance_km": r("sd / n", 4)}
_agg = f"count(*) AS n, {r('avg(coherence)')} AS mean_coherence, {r('avg(dist_km)', 4)} AS distance_km"


@query(f"SELECT s.id AS station, b.bin, {_agg} FROM {STATION_SQL} s JOIN {BINNED} b ON b.i <> s.id AND b.j <> s.id WHERE b.bin BETWEEN 0 AND 39 GROUP BY 1, 2")
def leave_one_station_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = cut(resample.by_station(binned(spark, sf_dir)))
    names = station(spark, sf_dir).select(F.col("id").alias("station"))
    out = resample.leave_out(parts, "station", 2, names)
    return select(out, {"station": "station", "bin": "bin", **_state})


@query(f"SELECT s.id AS station, b.bin, {_agg} FROM {STATION_SQL} s JOIN {BINNED} b ON b.i <> s.id AND b.j <> s.id WHERE b.bin BETWEEN 0 AND 39 GROUP BY 1, 2")
def leave_one_station_out_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from pair facts that are stored in buckets of their stations."""
    table = f"pairs_{uuid.uuid4().hex}"
    write_by_station(binned(spark, sf_dir).select("i", "j", "bin", "coherence", "dist_km"), table, 16)
    parts = cut(resample.by_stored_station(spark.table(table)))
    spark.sql(f"DROP TABLE {table}")
    names = station(spark, sf_dir).select(F.col("id").alias("station"))
    return select(resample.leave_out(parts, "station", 2, names), {"station": "station", "bin": "bin", **_state})


@query(f"SELECT m.month, b.bin, {_agg} FROM (SELECT DISTINCT year(date) * 12 + month(date) AS month FROM {BINNED} z WHERE bin BETWEEN 0 AND 39) m JOIN {BINNED} b ON year(b.date) * 12 + month(b.date) <> m.month WHERE b.bin BETWEEN 0 AND 39 GROUP BY 1, 2")
def leave_one_month_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = binned(spark, sf_dir).withColumn("month", F.year("date") * 12 + F.month("date"))
    return select(resample.leave_out(cut(accumulate(b, ["month"])), "month"), {"month": "month", "bin": "bin", **_state})


_without = "(SELECT p.{k}, b.bin, avg(b.coherence) AS mean_coherence, avg(b.dist_km) AS distance_km, count(*) AS n FROM {p} p JOIN {b} b ON {on} WHERE b.bin BETWEEN 0 AND 39 GROUP BY 1, 2 HAVING count(*) >= 50)"
_stations = _without.format(k="station", p=f"(SELECT id AS station FROM {STATION_SQL} s)", b=BINNED, on="b.i <> p.station AND b.j <> p.station")
#: By subtraction here too: each day times all rows is too much for a twin.
_days = f"""(SELECT d.date, d.bin, (t.s1 - coalesce(o.s1, 0)) / (t.n - coalesce(o.n, 0)) AS mean_coherence, (t.sd - coalesce(o.sd, 0)) / (t.n - coalesce(o.n, 0)) AS distance_km, t.n - coalesce(o.n, 0) AS n
    FROM (SELECT DISTINCT z.date, y.bin FROM {BINNED} z, (SELECT DISTINCT bin FROM {BINNED} x WHERE bin BETWEEN 0 AND 39) y WHERE z.bin BETWEEN 0 AND 39) d
    JOIN (SELECT bin, sum(coherence) AS s1, sum(dist_km) AS sd, count(*) AS n FROM {BINNED} w GROUP BY bin) t ON t.bin = d.bin
    LEFT JOIN (SELECT date, bin, sum(coherence) AS s1, sum(dist_km) AS sd, count(*) AS n FROM {BINNED} v GROUP BY 1, 2) o ON o.date = d.date AND o.bin = d.bin WHERE t.n - coalesce(o.n, 0) >= 50)"""


@query(fits_text(["station"], _stations))
def leave_one_station_out_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refit without each station, all in one job."""
    parts = cut(resample.by_station(binned(spark, sf_dir)))
    names = station(spark, sf_dir).select(F.col("id").alias("station"))
    return fits_of(fit.fit_decay(finalise(resample.leave_out(parts, "station", 2, names)), ["station"]), ["station"])


@query(fits_text(["date"], _days))
def leave_one_day_out_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refit without each day."""
    parts = cut(accumulate(binned(spark, sf_dir), ["date"]))
    return fits_of(fit.fit_decay(finalise(resample.leave_out(parts, "date")), ["date"]), ["date"])


_fold = f"(year(date) * 12 + month(date)) % {DEFAULT.monthly_folds}"
_score = {"n_bins": "count(*)", "rmse": r("sqrt(sum(n * pow(y - p, 2)) / sum(n))", 4), "nrmse": r("sqrt(sum(n * pow(y - p, 2)) / sum(n)) / (max(y) - min(y))", 3), "mae": r("sum(n * abs(y - p)) / sum(n)", 4), "r2": r("1 - sum(n * pow(y - p, 2)) / (sum(n * y * y) - pow(sum(n * y), 2) / sum(n))", 3), "log_lik": r("-0.5 * sum(n * pow(y - p, 2))", 2)}


def scored(fits: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Held-out bins against the prediction of the fit that did not see them."""
    j = held.join(fits.select(key, "theta", "amplitude", "offset_c"), key)
    p = j.selectExpr(key, "n", "mean_coherence AS y", "amplitude * exp(-distance_km / theta) + offset_c AS p")
    return p.groupBy(key).agg(*[F.expr(v).alias(k) for k, v in _score.items()])


_folds = f"(SELECT *, {_fold} AS fold FROM {BINNED} q)"
_train = f"(SELECT k.fold, b.bin, avg(coherence) AS mean_coherence, avg(dist_km) AS distance_km, count(*) AS n FROM (SELECT DISTINCT fold FROM {_folds} z) k JOIN {_folds} b ON b.fold <> k.fold WHERE b.bin BETWEEN 0 AND 39 GROUP BY 1, 2 HAVING count(*) >= 50)"
_held = f"(SELECT fold, bin, avg(coherence) AS mean_coherence, avg(dist_km) AS distance_km, count(*) AS n FROM {_folds} b WHERE bin BETWEEN 0 AND 39 GROUP BY 1, 2 HAVING count(*) >= 10)"


@query(f"SELECT fold, {', '.join(f'{v} AS {k}' for k, v in _score.items())} FROM (SELECT h.fold, h.n, h.mean_coherence AS y, f.amplitude * exp(-h.distance_km / f.theta) + f.offset_c AS p FROM {_held} h JOIN {fit.fit_decay_sql(_train, ['fold'])} f ON f.fold = h.fold) s GROUP BY fold")
def monthly_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = binned(spark, sf_dir).withColumn("fold", F.expr(_fold))
    parts = cut(accumulate(b, ["fold"]))
    train = finalise(resample.leave_out(parts, "fold"))
    return scored(fit.fit_decay(train, ["fold"]), finalise(parts, 10), "fold")


_blocks = f"(SELECT id, cast(floor((row_number() OVER (ORDER BY md5(cast(id AS varchar))) - 1) / {DEFAULT.station_block}) AS int) AS block FROM {STATION_SQL} s)"
_blocked = f"(SELECT q.*, a.block AS b_i, b.block AS b_j FROM {BINNED} q JOIN {_blocks} a ON a.id = q.i JOIN {_blocks} b ON b.id = q.j WHERE bin BETWEEN 0 AND 39)"
_block_train = _without.format(k="block", p=f"(SELECT DISTINCT block FROM {_blocks} s)", b=_blocked, on="b.b_i <> p.block AND b.b_j <> p.block")
_block_held = f"(SELECT p.block, b.bin, avg(b.coherence) AS mean_coherence, avg(b.dist_km) AS distance_km, count(*) AS n FROM (SELECT DISTINCT block FROM {_blocks} s) p JOIN {_blocked} b ON b.b_i = p.block OR b.b_j = p.block GROUP BY 1, 2 HAVING count(*) >= 10)"


@query(f"SELECT block, {', '.join(f'{v} AS {k}' for k, v in _score.items())} FROM (SELECT h.block, h.n, h.mean_coherence AS y, f.amplitude * exp(-h.distance_km / f.theta) + f.offset_c AS p FROM {_block_held} h JOIN {fit.fit_decay_sql(_block_train, ['block'])} f ON f.block = h.block) s GROUP BY block")
def station_block_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of stations in hash order; the held-out rows of a block are all pairs that touch it."""
    s = station(spark, sf_dir).withColumn("one", F.lit(1))  # the dimension of places
    order = Window.partitionBy("one").orderBy(F.md5(F.col("id").cast("string")))
    blocks = s.select("id", F.floor((F.row_number().over(order) - 1) / DEFAULT.station_block).cast("int").alias("block"))
    b = binned(spark, sf_dir)
    for e in "ij":
        b = b.join(blocks.select(F.col("id").alias(e), F.col("block").alias(f"b_{e}")), e)
    totals, parts = resample.by_either_end(b, "b_i", "b_j", "block")
    train = finalise(resample.leave_out(parts, "block", totals=totals))
    return scored(fit.fit_decay(train, ["block"]), finalise(parts, 10).where("n >= 10"), "block")


_run = "OVER (ORDER BY fold ROWS UNBOUNDED PRECEDING)"
_folded = {"fold": "fold", "theta": r("theta", 1), "mean": r("mean", 1), "sd": r("sd", 0), "cv": r("sd / mean", 3), "running_mean": r("running_mean", 1), "running_sd": r("running_sd", 0), "outlier": "theta < q1 - 1.5 * (q3 - q1) OR theta > q3 + 1.5 * (q3 - q1)"}


@query(f"SELECT {', '.join(f'{v} AS {k}' for k, v in _folded.items())} FROM (SELECT fold, theta, avg(theta) OVER () AS mean, stddev_pop(theta) OVER () AS sd, avg(theta) {_run} AS running_mean, stddev_pop(theta) {_run} AS running_sd, quantile_cont(theta, 0.25) OVER () AS q1, quantile_cont(theta, 0.75) OVER () AS q3 FROM {fit.fit_decay_sql(_train, ['fold'])} f WHERE amplitude > 0.0001) s")
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation and relative deviation of the decay lengths of the folds that decay, IQR outliers, running means."""
    b = binned(spark, sf_dir).withColumn("fold", F.expr(_fold))
    f = fit.fit_decay(finalise(resample.leave_out(cut(accumulate(b, ["fold"])), "fold")), ["fold"]).where("amplitude > 0.0001").withColumn("one", F.lit(1))
    q = F.percentile("theta", [0.25, 0.75]).over(Window.partitionBy("one"))
    run = Window.partitionBy("one").orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    w = Window.partitionBy("one")
    s = f.withColumn("q", q).select("fold", "theta", F.avg("theta").over(w).alias("mean"), F.stddev_pop("theta").over(w).alias("sd"), F.avg("theta").over(run).alias("running_mean"), F.stddev_pop("theta").over(run).alias("running_sd"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    return select(s, _folded)


_regioned = f"(SELECT *, {geo.region('lon_i')} AS r_i, {geo.region('lon_j')} AS r_j FROM {BINNED} q WHERE bin BETWEEN 0 AND 39)"
_regions = _without.format(k="region", p=f"(SELECT DISTINCT r_i AS region FROM {_regioned} s UNION SELECT r_j FROM {_regioned} t)", b=_regioned, on="b.r_i <> p.region AND b.r_j <> p.region")


@query(fits_text(["region"], _regions))
def regional_jackknife(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refit without all pairs that touch a region."""
    b = binned(spark, sf_dir).withColumns({f"r_{e}": F.expr(geo.region(f"lon_{e}")) for e in "ij"})
    totals, parts = resample.by_either_end(b, "r_i", "r_j", "region")
    return fits_of(fit.fit_decay(finalise(resample.leave_out(parts, "region", totals=totals)), ["region"]), ["region"])


_by_center = bins_sql("center")


@query(fits_text(["center", "dropped"], f"(SELECT a.*, b.bin AS dropped FROM {_by_center} a JOIN {_by_center} b ON a.center = b.center AND a.bin <> b.bin)"))
def drop_one_bin_jackknife(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refit without each bin of each centre."""
    b = bins(spark, sf_dir, ["center"])
    dropped = b.select("center", F.col("bin").alias("dropped"))
    return fits_of(fit.fit_decay(b.join(dropped, "center").where("bin <> dropped"), ["center", "dropped"]), ["center", "dropped"])


_tenth = f"(SELECT * FROM (SELECT b.*, replicate, row_number() OVER (PARTITION BY center, replicate ORDER BY md5(replicate || '#' || bin)) AS h, count(*) OVER (PARTITION BY center, replicate) AS m FROM {_by_center} b, range(1, 21) t(replicate)) q WHERE h > ceil(m / 10.0))"


@query(fits_text(["center", "replicate"], _tenth))
def bin_jackknife(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty refits, each without about a tenth of the bins in hash order."""
    b = bins(spark, sf_dir, ["center"]).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(20))))
    w = Window.partitionBy("center", "replicate")
    kept = b.withColumn("h", F.row_number().over(w.orderBy(F.md5(F.concat_ws("#", "replicate", "bin"))))).withColumn("m", F.count("*").over(w)).where(F.col("h") > F.ceil(F.col("m") / 10))
    return fits_of(fit.fit_decay(kept, ["center", "replicate"]), ["center", "replicate"])


REPLICATE = {"amplitude": r("amplitude", 3), "wrss": r("wrss", 3), "n_bins": "n_bins"}


def _draw_text(of: str, *parts: str) -> str:
    return f"(('0x' || substr(md5({' || chr(35) || '.join(parts)}), 1, 12))::bigint % {of})"


def block_draws(bins: DataFrame, replicates: int, size: int) -> DataFrame:
    """(center, replicate, bins...): runs of `size` neighbouring bins, drawn with replacement until a replicate has as many bins as there are.

    The last run is cut, so that no replicate has more.
    """
    w = Window.partitionBy("center")
    placed = bins.withColumns({"k": F.row_number().over(w.orderBy("bin")) - 1, "m": F.count("*").over(w)})  # a few dozen bins a centre
    starts = placed.select("center", "m").distinct().withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("draw", F.explode(F.sequence(F.lit(0), F.ceil(F.col("m") / size).cast("int") - 1)))
    starts = starts.withColumn("start", resample.draw(F.greatest(F.col("m") - size + 1, F.lit(1)), F.lit("block"), F.col("replicate").cast("string"), F.col("draw").cast("string")))
    picks = starts.withColumn("off", F.explode(F.sequence(F.lit(0), F.least(F.lit(size), F.col("m") - F.col("draw") * size).cast("int") - 1)))
    return picks.select("center", "replicate", (F.col("start") + F.col("off")).alias("k")).join(placed, ["center", "k"])


_size = DEFAULT.bootstrap_block
_placed = f"(SELECT *, row_number() OVER (PARTITION BY center ORDER BY bin) - 1 AS k, count(*) OVER (PARTITION BY center) AS m FROM {bins_sql('center')} b)"
_blocks = f"""(SELECT p.*, replicate FROM (SELECT center, replicate, s + o AS k FROM (SELECT center, m, replicate, draw, {_draw_text(f'greatest(m - {_size} + 1, 1)', "'block'", 'replicate', 'draw')} AS s
    FROM (SELECT DISTINCT center, m FROM {_placed} q) c, range(1, {DEFAULT.bootstrap + 1}) t(replicate), range(0, 40) d(draw) WHERE draw * {_size} < m) x, range(0, {_size}) f(o) WHERE draw * {_size} + o < m) z JOIN {_placed} p ON p.center = z.center AND p.k = z.k)"""
_interval = {"replicates": "count(*)", **{f"{c}_{n}": r(f"percentile({c}, {q})", 3) for c in ("amplitude", "wrss") for n, q in (("low", 0.025), ("middle", 0.5), ("high", 0.975))}}


@query(f"SELECT center, {', '.join(f'{v} AS {k}' for k, v in _interval.items()).replace('percentile(', 'quantile_cont(')} FROM {fit.fit_decay_sql(_blocks, ['center', 'replicate'])} f GROUP BY center")
def block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile intervals over resampled runs of bins."""
    return interval_of(bins(spark, sf_dir, ["center"]), DEFAULT.bootstrap)


def interval_of(b: DataFrame, replicates: int) -> DataFrame:
    fits = fit.fit_decay(block_draws(b, replicates, DEFAULT.bootstrap_block), ["center", "replicate"])
    return fits.groupBy("center").agg(*[F.expr(v).alias(k) for k, v in _interval.items()])


_seeds = ", ".join(f"({b}, {f}, {a})" for b, (f, a) in enumerate(resample.poisson_seeds(DEFAULT.pair_replicates), 1))
_weighted = f"(SELECT replicate, bin, coherence, dist_km, {resample.poisson_text('row', 'pf', 'pa')} AS w FROM (SELECT row, bin, coherence, dist_km FROM {BINNED} q WHERE bin BETWEEN 0 AND 39) b, (VALUES {_seeds}) t(replicate, pf, pa))"
_weighted = f"(SELECT replicate, bin, sum(w * coherence) / sum(w) AS mean_coherence, sum(w * dist_km) / sum(w) AS distance_km, cast(sum(w) AS bigint) AS n FROM {_weighted} z GROUP BY 1, 2 HAVING sum(w) >= 50)"


@query(f"SELECT replicate, {', '.join(f'{v} AS {k}' for k, v in REPLICATE.items())} FROM {fit.fit_decay_sql(_weighted, ['replicate'])} f")
def pair_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row weighs Poisson(1) in every replicate; the weights are folded into vectors of bin sums, no row is copied."""
    return select(pair_bootstrap_fits(spark, sf_dir, DEFAULT.pair_replicates), {"replicate": "replicate", **REPLICATE})


def pair_bootstrap_fits(spark: SparkSession, sf_dir: str, replicates: int) -> DataFrame:
    seeds = resample.poisson_seeds(replicates)
    states = resample.replicate_states(binned(spark, sf_dir), None, ["row"], lambda b: resample.poisson_weights(np.asarray(b.column("row")), seeds), replicates)
    return fit.fit_decay(finalise(states), ["replicate"])


_two = DEFAULT.two_way_replicates
_kept = lambda kind, name, source: f"(SELECT DISTINCT b + 1 AS replicate, {name} FROM (SELECT b, {_draw_text('s', chr(39) + kind + chr(39), 'b', 'k')} AS pick FROM (SELECT count(*) AS s FROM {source} c) n, range(0, {_two}) x(b), range(0, 10000) y(k) WHERE k < s) p JOIN (SELECT {name}, row_number() OVER (ORDER BY {name}) - 1 AS rk FROM {source} v) l ON l.rk = p.pick)"
_stations = _kept("station", "st", f"(SELECT i AS st FROM {BINNED} u1 WHERE bin BETWEEN 0 AND 39 UNION SELECT j FROM {BINNED} u2 WHERE bin BETWEEN 0 AND 39)")
_dates = _kept("day", "date", f"(SELECT DISTINCT date FROM {BINNED} u3 WHERE bin BETWEEN 0 AND 39)")
_two_way = f"""(SELECT d.replicate, bin, sum(coherence) / count(*) AS mean_coherence, sum(dist_km) / count(*) AS distance_km, count(*) AS n FROM (SELECT * FROM {BINNED} q WHERE bin BETWEEN 0 AND 39) b
    JOIN {_dates} d ON d.date = b.date LEFT JOIN {_stations} si ON si.st = b.i AND si.replicate = d.replicate LEFT JOIN {_stations} sj ON sj.st = b.j AND sj.replicate = d.replicate
    WHERE si.st IS NOT NULL OR sj.st IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10)"""


@query(f"SELECT replicate, {', '.join(f'{v} AS {k}' for k, v in REPLICATE.items())} FROM {fit.fit_decay_sql(_two_way, ['replicate'])} f")
def two_way_block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations and days drawn with replacement; a row is kept once if its day and one of its stations were drawn.

    A station and a day hold one bit a replicate, so a row's replicates are the meeting of three bitmaps.
    """
    return select(two_way_fits(binned(spark, sf_dir), DEFAULT.two_way_replicates), {"replicate": "replicate", **REPLICATE})


def two_way_fits(pairs: DataFrame, replicates: int) -> DataFrame:
    names = cut(pairs.select(F.explode(F.array("i", "j")).alias("station"), "date"))
    stations = small(cut(resample.drawn_bitmaps(names, "station", replicates, "station")))
    days = small(cut(resample.drawn_bitmaps(names, "date", replicates, "day")))
    rows = pairs
    for e in "ij":
        rows = rows.join(stations.select(F.col("station").alias(e), F.col("bits").alias(f"bits_{e}")), e)
    either = F.zip_with("bits_i", "bits_j", lambda a, b: a.bitwiseOR(b))
    rows = rows.join(days, "date").withColumn("kept", F.zip_with(either, "bits", lambda a, b: a.bitwiseAND(b)))
    words = -(-replicates // resample.WORD_BITS)
    weights = lambda b: resample.unpacked(np.asarray(b.column("kept").flatten()).reshape(-1, words), replicates)
    return fit.fit_decay(finalise(resample.replicate_states(rows, None, ["kept"], weights, replicates), 10), ["replicate"])


@query()
def distance_shuffle_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits after permuting the distances over each centre's rows, one fit for each iteration."""
    return fit.fit_decay(finalise(null_states(spark, sf_dir, "distance", DEFAULT.null_iterations)), ["center", "iteration"])


def null_states(spark: SparkSession, sf_dir: str, kind: str, iterations: int) -> DataFrame:
    """(center, iteration, bin, state): a centre's bin sums under each permutation of distances, phases or a day's stations.

    Phases over rows are distances over phases: either way each phase meets one distance of its centre by chance.
    """
    if kind == "station":
        return resample.relabelled_states(pair_day(spark, sf_dir, False), iterations, ["center", "date"], pair_places(spark, sf_dir).select("i", "j", "dist_km", "bin"))
    p = pair_day(spark, sf_dir).withColumn("bin", distance_bin("dist_km"))
    if kind == "phase":
        p = p.withColumn("coherence", F.cos("phase"))
    return resample.permuted_states(p, "row", iterations, "center", 1 + (kind == "phase"))


_permuted = f"(SELECT a.row, b.v AS phase_shuffled FROM (SELECT row, row_number() OVER (ORDER BY row) AS k FROM {PAIR_DAY_SQL} p) a JOIN (SELECT phase AS v, row_number() OVER (ORDER BY md5(row || '#42')) AS k FROM {PAIR_DAY_SQL} q) b ON a.k = b.k)"


@query(f"SELECT row, {r('phase_shuffled')} AS phase_shuffled FROM {_permuted} z")
def phase_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The global permutation itself, row by row: a distributed rank on either side."""
    p = pair_day(spark, sf_dir, False).select("row", "phase")
    return select(resample.permute(p, "row", "phase", 42), {"row": "row", "phase_shuffled": r("phase")})


@query(f"""SELECT p.date, count(*) AS n, {r('avg(' + geo.great_circle('a.lat', 'a.lon', 'b.lat', 'b.lon') + ')', 3)} AS mean_km
    FROM {PAIR_DAY_SQL} p
    JOIN (SELECT x.date, x.s, y.s AS t FROM (SELECT date, s, row_number() OVER (PARTITION BY date ORDER BY s) AS k FROM (SELECT date, i AS s FROM {PAIR_DAY_SQL} u1 UNION SELECT date, j FROM {PAIR_DAY_SQL} u2) d1) x
          JOIN (SELECT date, s, row_number() OVER (PARTITION BY date ORDER BY md5(date || '#' || s || '#42')) AS k FROM (SELECT date, i AS s FROM {PAIR_DAY_SQL} u3 UNION SELECT date, j FROM {PAIR_DAY_SQL} u4) d2) y ON x.date = y.date AND x.k = y.k) mi ON mi.date = p.date AND mi.s = p.i
    JOIN (SELECT x.date, x.s, y.s AS t FROM (SELECT date, s, row_number() OVER (PARTITION BY date ORDER BY s) AS k FROM (SELECT date, i AS s FROM {PAIR_DAY_SQL} u5 UNION SELECT date, j FROM {PAIR_DAY_SQL} u6) d3) x
          JOIN (SELECT date, s, row_number() OVER (PARTITION BY date ORDER BY md5(date || '#' || s || '#42')) AS k FROM (SELECT date, i AS s FROM {PAIR_DAY_SQL} u7 UNION SELECT date, j FROM {PAIR_DAY_SQL} u8) d4) y ON x.date = y.date AND x.k = y.k) mj ON mj.date = p.date AND mj.s = p.j
    JOIN {STATION_SQL} a ON a.id = mi.t JOIN {STATION_SQL} b ON b.id = mj.t GROUP BY p.date""")
def station_label_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair_day(spark, sf_dir, False).select("date", "i", "j")
    labels = cut(resample.relabel_by_day(p, 42))
    for e in "ij":
        p = p.join(labels.select("date", F.col("s").alias(e), F.col("t").alias(f"t_{e}")), ["date", e])
    ends = p.select("date", F.least("t_i", "t_j").alias("i"), F.greatest("t_i", "t_j").alias("j"))
    placed = ends.join(small(pair_places(spark, sf_dir).select("i", "j", "dist_km")), ["i", "j"])
    return placed.groupBy("date").agg(F.count("*").alias("n"), F.expr(r("avg(dist_km)", 3)).alias("mean_km"))


@query()
def null_summary(spark: SparkSession, sf_dir: str, iterations: int = DEFAULT.null_iterations) -> DataFrame:
    """Each centre's real fit beside permutations of its distances, phases and station labels: R2, length, permutation p of R2 and verdict."""
    real = fit.fit_decay(finalise(accumulate(binned(spark, sf_dir), ["center"])), ["center"]).select("center", F.col("r2").alias("real_r2"), F.col("theta").alias("real_theta"))
    states = None
    for kind in ("distance", "phase", "station"):
        s = cut(null_states(spark, sf_dir, kind, iterations).withColumn("null", F.lit(kind)))
        states = s if states is None else states.unionByName(s)
    nulls = fit.fit_decay(finalise(states), ["null", "center", "iteration"]).join(real, "center")
    out = nulls.groupBy("center", "null", "real_theta", "real_r2").agg(F.count("*").alias("iterations"), F.avg("r2").alias("null_r2"), F.stddev_pop("r2").alias("null_r2_sd"), F.avg("theta").alias("null_theta"), F.stddev_pop("theta").alias("null_theta_sd"), ((F.sum((F.col("r2") >= F.col("real_r2")).cast("int")) + 1) / (F.count("*") + 1)).alias("p_value"))
    return out.withColumns({"z": F.expr("CASE WHEN null_r2_sd > 0 THEN (real_r2 - null_r2) / null_r2_sd END"), "passes": F.col("p_value") < 0.05})


_u = lambda k: f"((row * {k} % 1000003 + 1) / 1000005D)"  # noqa: E731  a congruence draws alike in every engine
NOISE = {"gaussian": f"sqrt(-2 * ln({_u(48_271)})) * cos(2 * pi() * {_u(69_621)})", "uniform": f"2 * {_u(48_271)} - 1", "cosine": f"cos(2 * pi() * {_u(39_373)})"}
_noise = f"CASE flavour {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}' for k, v in NOISE.items())} END"
_noisy = f"(SELECT b.center, b.bin, b.dist_km, flavour, {_noise} AS coherence FROM {BINNED} b, (VALUES {', '.join(f'({chr(39)}{k}{chr(39)})' for k in NOISE)}) t(flavour))"


@query(fits_text(["center", "flavour"], bins_sql("center, flavour", _noisy)))
def structureless_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian, uniform and cosine noise on the true pair geometry."""
    b = binned(spark, sf_dir).withColumn("flavour", F.explode(F.array(*[F.lit(k) for k in NOISE]))).withColumn("coherence", F.expr(_noise))
    return fits_of(fit.fit_decay(finalise(accumulate(b, ["center", "flavour"])), ["center", "flavour"]), ["center", "flavour"])


_spread = {"centers": "count(*)", "mean": r("avg(theta)", 1), "sd": r("stddev_pop(theta)", 0), "cv": r("stddev_pop(theta) / avg(theta)", 3), "consistent": "stddev_pop(theta) / avg(theta) < 0.2"}


@query(f"SELECT {', '.join(f'{v} AS {k}' for k, v in _spread.items())} FROM {fit.fit_decay_sql(_by_center, ['center'])} f WHERE theta BETWEEN 100 AND 20000 AND amplitude > 0.0001")
def multi_center_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and relative deviation of the decay length over centres, and the verdict at 0.2."""
    f = fit.fit_decay(bins(spark, sf_dir, ["center"]), ["center"]).where("theta BETWEEN 100 AND 20000 AND amplitude > 0.0001")
    return f.agg(*[F.expr(v).alias(k) for k, v in _spread.items()])


RANGES = 5
_valid = f"(SELECT *, round(dist_km, 6) AS d6 FROM {BINNED} q WHERE bin BETWEEN 0 AND 39)"
_limits = f"(SELECT k, min(d6) AS lim FROM (SELECT d6, sum(n) OVER (ORDER BY d6) AS c, sum(n) OVER () AS t FROM (SELECT d6, count(*) AS n FROM {_valid} v GROUP BY 1) g) h, range(1, {RANGES}) s(k) WHERE c >= t * k / {RANGES}.0 GROUP BY k)"
_ranged = f"(SELECT v.*, (SELECT count(*) FROM {_limits} l WHERE v.d6 >= l.lim) AS range_id FROM {_valid} v)"


@query(fits_text(["range_id"], _without.format(k="range_id", p=f"(SELECT * FROM range(0, {RANGES}) t(range_id))", b=_ranged, on="b.range_id <> p.range_id")))
def distance_range_jackknife(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five equal-count distance ranges by exact quantiles of all rows; a refit without each."""
    b = binned(spark, sf_dir).withColumn("d6", F.round("dist_km", 6))
    counts = b.groupBy("d6").agg(F.count("*").alias("n"))
    limits = stats.weighted_percentile(counts, [], "d6", "n", [k / RANGES for k in range(1, RANGES)])
    cuts = [x["percentile"] for x in limits.collect()]  # four rows
    ranged = b.withColumn("range_id", sum(((F.col("d6") >= c).cast("int") for c in cuts), F.lit(0)))
    return fits_of(fit.fit_decay(finalise(resample.leave_out(cut(accumulate(ranged, ["range_id"])), "range_id")), ["range_id"]), ["range_id"])
