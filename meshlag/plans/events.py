"""Event windows, superposed epochs, sham dates, eclipses: J6, N5, A30-A33, M13, W4-W8, F8, C11-C16."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlag.functions import geo
from meshlag.operators import fit
from meshlag.operators.series import gradient, rolling_median, unwrap
from meshlag.plans.fixtures import DAILY_SQL, EXTERNAL_SQL, PAIR_DAY_SQL, STATION_SQL, daily, events_calendar, events_sql, external_daily, pair_day, station
from meshlag.plans.registry import query, r, select

WINDOW = 60


def around(daily_rows: DataFrame, events: DataFrame, half: int) -> DataFrame:
    """Rows within `half` days of an event, by equality: each event is exploded into its days."""
    days = events.withColumn("offset", F.explode(F.sequence(F.lit(-half), F.lit(half)))).withColumn("date", F.date_add("event_date", F.col("offset")))
    return daily_rows.join(days, "date")


def around_sql(rows: str, events: str, half: int) -> str:
    return f"(SELECT d.*, e.event_id, e.event_date, cast(d.date - e.event_date AS int) AS offset_d FROM {rows} d JOIN {events} e ON d.date BETWEEN e.event_date - {half} AND e.event_date + {half})"


@query(f"SELECT event_id, offset_d AS day_offset, n, {r('m')} AS mean_coherence FROM {around_sql(DAILY_SQL, events_sql(), WINDOW)} a")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = around(daily(spark, sf_dir), events_calendar(spark, sf_dir), WINDOW)
    return select(a, {"event_id": "event_id", "day_offset": "offset", "n": "n", "mean_coherence": r("m")})


@query(f"SELECT offset_d AS day_offset, count(*) AS events, {r('avg(m)')} AS mean, {r('median(m)')} AS median FROM {around_sql(DAILY_SQL, events_sql(), 30)} a GROUP BY 1")
def superposed_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = around(daily(spark, sf_dir), events_calendar(spark, sf_dir), 30)
    return a.groupBy(F.col("offset").alias("day_offset")).agg(F.count("*").alias("events"), F.expr(r("avg(m)")).alias("mean"), F.expr(r("percentile(m, 0.5)")).alias("median"))


_eff = {"peak_n": "cast(sum(CASE WHEN abs({o}) <= 5 THEN 1 ELSE 0 END) AS bigint)", "peak_mean": r("avg(CASE WHEN abs({o}) <= 5 THEN m END)"), "base_mean": r("avg(CASE WHEN abs({o}) BETWEEN 30 AND 60 THEN m END)"), "effect": r("(avg(CASE WHEN abs({o}) <= 5 THEN m END) - avg(CASE WHEN abs({o}) BETWEEN 30 AND 60 THEN m END)) / stddev_samp(CASE WHEN abs({o}) BETWEEN 30 AND 60 THEN m END)", 5)}


def _effects(o: str) -> str:
    return ", ".join(f"{v.replace('{o}', o)} AS {k}" for k, v in _eff.items())


@query(f"SELECT event_id, {_effects('offset_d')} FROM {around_sql(DAILY_SQL, events_sql(), WINDOW)} a GROUP BY event_id")
def event_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = around(daily(spark, sf_dir), events_calendar(spark, sf_dir), WINDOW)
    return a.groupBy("event_id").agg(*[F.expr(v.replace("{o}", "offset")).alias(k) for k, v in _eff.items()])


_sham = f"(SELECT event_id * 10 + k AS event_id, event_date + cast((k - 1) * 29 AS int) AS event_date FROM {events_sql()} e, range(0, 3) t(k))"
_t = "(avg(CASE WHEN real THEN x END) - avg(CASE WHEN NOT real THEN x END)) / sqrt(var_samp(CASE WHEN real THEN x END) / sum(CASE WHEN real THEN 1 ELSE 0 END) + var_samp(CASE WHEN NOT real THEN x END) / sum(CASE WHEN NOT real THEN 1 ELSE 0 END))"


@query(f"SELECT count(*) AS windows, {r(_t, 4)} AS t_stat, {r('avg(CASE WHEN real THEN x END)')} AS real_mean, {r('avg(CASE WHEN NOT real THEN x END)')} AS sham_mean FROM (SELECT event_id, event_id % 10 = 1 AS real, avg(m) AS x FROM {around_sql(DAILY_SQL, _sham, 5)} a GROUP BY 1, 2) q")
def sham_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events_calendar(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    e = e.select((F.col("event_id") * 10 + F.col("k")).alias("event_id"), F.date_add("event_date", (F.col("k") - 1) * 29).alias("event_date"))
    a = around(daily(spark, sf_dir), e, 5).groupBy("event_id").agg(F.avg("m").alias("x")).withColumn("real", F.col("event_id") % 10 == 1)
    return a.agg(F.count("*").alias("windows"), F.expr(r(_t, 4)).alias("t_stat"), F.expr(r("avg(CASE WHEN real THEN x END)")).alias("real_mean"), F.expr(r("avg(CASE WHEN NOT real THEN x END)")).alias("sham_mean"))


@query(f"SELECT count(*) AS events, {r('avg(x)')} AS mean_effect, {r('avg(x) / (stddev_samp(x) / sqrt(count(*)))', 4)} AS t_stat FROM (SELECT event_id, avg(CASE WHEN abs(offset_d) <= 5 THEN m END) - avg(CASE WHEN abs(offset_d) BETWEEN 30 AND 60 THEN m END) AS x FROM {around_sql(DAILY_SQL, events_sql(), WINDOW)} a GROUP BY 1) q")
def one_sample_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = around(daily(spark, sf_dir), events_calendar(spark, sf_dir), WINDOW)
    x = a.groupBy("event_id").agg(F.expr("avg(CASE WHEN abs(offset) <= 5 THEN m END) - avg(CASE WHEN abs(offset) BETWEEN 30 AND 60 THEN m END)").alias("x"))
    return x.agg(F.count("*").alias("events"), F.expr(r("avg(x)")).alias("mean_effect"), F.expr(r("avg(x) / (stddev_samp(x) / sqrt(count(*)))", 4)).alias("t_stat"))


CENTRES, WIDTHS = [float(x) for x in range(-20, 21, 2)], [3.0, 5.0, 10.0, 15.0, 20.0]
_peak = {"event_id": "event_id", "centre": "centre", "width": "width", "amplitude": r("amplitude", 5), "level": r("level", 5), "r2": r("r2", 4), "se_amplitude": r("se_amplitude", 5), "n": "n", "significant": "coalesce(abs(amplitude) > 2 * se_amplitude, false)"}


@query(f"SELECT {', '.join(f'{v} AS {k}' for k, v in _peak.items())} FROM {fit.fit_peak_sql(around_sql(DAILY_SQL, events_sql(), 60), ['event_id'], 'offset_d', 'm', CENTRES, WIDTHS)} f")
def event_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian peak of each event's daily curve, over a grid of centres and widths."""
    a = around(daily(spark, sf_dir), events_calendar(spark, sf_dir), 60)
    return select(fit.fit_peak(a, ["event_id"], "offset", "m", CENTRES, WIDTHS), _peak)


@query(f"""SELECT o AS day_offset, {r('x')} AS median_m, {r('CASE WHEN c = 3 THEN med END')} AS rolling FROM (SELECT o, x, median(x) OVER w AS med, count(x) OVER w AS c FROM (
    SELECT o, median(m) AS x FROM range(-20, 21) t(o) LEFT JOIN {around_sql(DAILY_SQL, events_sql(), 20)} a ON a.offset_d = o GROUP BY o) q WINDOW w AS (ORDER BY o ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) z""")
def event_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median curve over events on the full offset axis, gaps null, with a rolling median."""
    a = around(daily(spark, sf_dir), events_calendar(spark, sf_dir), 20)
    curve = a.groupBy("offset").agg(F.median("m").alias("median_m"))
    axis = spark.range(-20, 21).select(F.col("id").cast("int").alias("offset"))
    rolled = rolling_median(axis.join(curve, "offset", "left").withColumn("one", F.lit(1)), ["one"], "offset", "median_m", 1, "rolling")
    return select(rolled, {"day_offset": "offset", "median_m": r("median_m"), "rolling": r("rolling")})


_phase_s = "atan2(sum(abs(coherence) * sin(phase)), sum(abs(coherence) * cos(phase)))"


_phases = f"(SELECT date, {_phase_s} AS phase FROM {PAIR_DAY_SQL} p GROUP BY date)"
_turned = f"(SELECT event_id, offset_d, phase, coalesce(phase - lag(phase) OVER w, 0) AS step FROM {around_sql(_phases, events_sql(), 20)} a WINDOW w AS (PARTITION BY event_id ORDER BY offset_d))"
_unwrapped = f"(SELECT event_id, cast(offset_d AS double) AS t, phase + sum(-2 * pi() * ceil((step - pi()) / (2 * pi()))) OVER (PARTITION BY event_id ORDER BY offset_d) AS u FROM {_turned} q)"
_slopes = f"(SELECT event_id, t, coalesce((hs * hs * a + hd * hd * b) / (hs * hd * (hd + hs)), a / hd, b / hs) AS g FROM (SELECT event_id, t, t - lag(t) OVER w AS hs, lead(t) OVER w - t AS hd, u - lag(u) OVER w AS b, lead(u) OVER w - u AS a FROM {_unwrapped} z WINDOW w AS (PARTITION BY event_id ORDER BY t)) y)"


@query(f"SELECT event_id, {r('avg(CASE WHEN t BETWEEN -5 AND -1 THEN g END)', 5)} AS before, {r('avg(CASE WHEN t BETWEEN 1 AND 5 THEN g END)', 5)} AS after FROM {_slopes} x GROUP BY event_id")
def phase_modulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unwrapped daily phase around events, its gradient, and its mean before and after the day."""
    p = pair_day(spark, sf_dir, False).groupBy("date").agg(F.expr(_phase_s).alias("phase"))
    a = around(p, events_calendar(spark, sf_dir), 20).withColumn("t", F.col("offset").cast("double"))
    g = gradient(unwrap(a, ["event_id"], "t", "phase"), ["event_id"], "t", "unwrapped")
    sides = g.groupBy("event_id").agg(F.avg(F.when(F.col("offset").between(-5, -1), F.col("gradient"))).alias("before"), F.avg(F.when(F.col("offset").between(1, 5), F.col("gradient"))).alias("after"))
    return select(sides, {"event_id": "event_id", "before": r("before", 5), "after": r("after", 5)})


@query(f"""SELECT ph AS phase, count(*) AS bins, {r('avg(m)')} AS mean_of_means FROM (
    SELECT {geo.eclipse_phase('offset_d * 20')} AS ph, event_id, offset_d, avg(m) AS m FROM {around_sql(DAILY_SQL, events_sql(), 20)} a GROUP BY 1, 2, 3) q GROUP BY 1""")
def event_phase_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = around(daily(spark, sf_dir), events_calendar(spark, sf_dir), 20)
    first = a.groupBy(F.expr(geo.eclipse_phase("offset * 20")).alias("phase"), "event_id", "offset").agg(F.avg("m").alias("m"))
    return first.groupBy("phase").agg(F.count("*").alias("bins"), F.expr(r("avg(m)")).alias("mean_of_means"))


_days = "date_diff('day', date '2000-01-01', date)"
_bin36 = "cast(floor(round({p}, 9) / (2 * pi()) * 36) AS int)"


@query(f"SELECT {_bin36.format(p=geo.cycle_phase('dd', 224.7))} AS phase_bin, count(*) AS n, {r('corr(coherence, dist_km)', 5)} AS c FROM (SELECT *, {_days} AS dd FROM {PAIR_DAY_SQL} p) q GROUP BY 1")
def orbital_phase_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair_day(spark, sf_dir).withColumn("dd", F.datediff("date", F.lit("2000-01-01").cast("date")))
    return p.groupBy(F.expr(_bin36.format(p=geo.cycle_phase("dd", 224.7))).alias("phase_bin")).agg(F.count("*").alias("n"), F.expr(r("corr(coherence, dist_km)", 5)).alias("c"))


PERIODS = (27.3, 121.75, 182.6, 365.25, 433.0)
_fold_bin = "cast(floor(round((((dd / period) % 1) + 1) % 1, 9) * 18) AS int)"
_ew = geo.compass_class(f"round({geo.azimuth('lat_i', 'lon_i', 'lat_j', 'lon_j')}, 9)")


@query(f"SELECT period, {_fold_bin} AS phase_bin, count(*) AS n, {r('avg(CASE WHEN cls = ' + chr(39) + 'EW' + chr(39) + ' THEN coherence END)')} AS ew, {r('avg(CASE WHEN cls = ' + chr(39) + 'NS' + chr(39) + ' THEN coherence END)')} AS ns FROM (SELECT coherence, {_days} AS dd, {_ew} AS cls FROM {PAIR_DAY_SQL} p) q, (VALUES {', '.join(f'({p}::double)' for p in PERIODS)}) t(period) GROUP BY 1, 2")
def phase_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair_day(spark, sf_dir).withColumn("dd", F.datediff("date", F.lit("2000-01-01").cast("date"))).withColumn("cls", F.expr(_ew))
    daily_dir = p.groupBy("dd", "cls").agg(F.sum("coherence").alias("s"), F.count("*").alias("n"))  # one row a day and class before the periods fan out
    f = daily_dir.withColumn("period", F.explode(F.array(*[F.lit(x) for x in PERIODS])))
    mean = lambda c: f"sum(CASE WHEN cls = '{c}' THEN s END) / sum(CASE WHEN cls = '{c}' THEN n END)"
    return f.groupBy("period", F.expr(_fold_bin).alias("phase_bin")).agg(F.sum("n").alias("n"), F.expr(r(mean("EW"))).alias("ew"), F.expr(r(mean("NS"))).alias("ns"))


@query(f"SELECT period, {', '.join(r(c, 4) + ' AS ' + c for c in ('amplitude', 'level', 'r2'))}, n FROM " + fit.fit_harmonic_sql(f"(SELECT period, m AS y, 2 * pi() * (((dd / period) % 1 + 1) % 1) AS ph FROM (SELECT m, {_days} AS dd FROM {DAILY_SQL} d) q, (VALUES {', '.join(f'({p}::double)' for p in PERIODS)}) t(period))", ["period"], "ph", "y") + " h")
def cycle_harmonics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir).select("m", F.datediff("date", F.lit("2000-01-01").cast("date")).alias("dd"))
    rows = d.withColumn("period", F.explode(F.array(*[F.lit(x) for x in PERIODS]))).withColumn("ph", F.expr("2 * pi() * (((dd / period) % 1 + 1) % 1)"))
    h = fit.fit_harmonic(rows, ["period"], "ph", "m")
    return select(h, {"period": "period", "amplitude": r("amplitude", 4), "level": r("level", 4), "r2": r("r2", 4), "n": "n"})


_BASE = (1.0, 27.32, 365.25, 433.0)
_freq = f"(SELECT row_number() OVER () AS id, 1 / p AS f FROM (VALUES {', '.join(f'({p}::double)' for p in _BASE)}) t(p))"


@query(f"SELECT {r('1 / f', 4)} AS period, kind FROM (SELECT a.f + b.f AS f, 'sum' AS kind FROM {_freq} a JOIN {_freq} b ON a.id < b.id UNION ALL SELECT abs(a.f - b.f), 'difference' FROM {_freq} a JOIN {_freq} b ON a.id < b.id) q WHERE 1 / f >= 7 AND (SELECT max(l_shipdate::date) - min(l_shipdate::date) FROM lineitem) * f >= 3")
def beat_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and differences of base frequencies with a period of 7 days or more and 3 cycles in the data."""
    from meshlag.plans.fixtures import read

    span = read(spark, sf_dir, "lineitem").agg(F.datediff(F.max("l_shipdate"), F.min("l_shipdate")).alias("span"))
    f = span.select("span", F.posexplode(F.array(*[F.lit(1 / p) for p in _BASE])).alias("id", "f"))
    pairs = f.join(f.select(F.col("id").alias("id2"), F.col("f").alias("g")), F.col("id") < F.col("id2"))
    both = pairs.select("span", F.explode(F.array(F.struct((F.col("f") + F.col("g")).alias("f"), F.lit("sum").alias("kind")), F.struct(F.abs(F.col("f") - F.col("g")).alias("f"), F.lit("difference").alias("kind")))).alias("b")).select("span", "b.*")
    return select(both.where("1 / f >= 7 AND span * f >= 3"), {"period": r("1 / f", 4), "kind": "kind"})


@query(f"SELECT wk AS week, {r('avg(coherence)')} AS collective, {r('stddev_samp(coherence)')} AS spread, count(*) AS n, count(DISTINCT i * 100 + j) AS pairs FROM (SELECT *, cast(floor({_days} / 7) AS int) AS wk FROM {PAIR_DAY_SQL} p) q GROUP BY 1")
def weekly_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair_day(spark, sf_dir, False).withColumn("week", F.floor(F.datediff("date", F.lit("2000-01-01").cast("date")) / 7).cast("int"))
    return p.groupBy("week").agg(F.expr(r("avg(coherence)")).alias("collective"), F.expr(r("stddev_samp(coherence)")).alias("spread"), F.count("*").alias("n"), F.countDistinct(F.col("i") * 100 + F.col("j")).alias("pairs"))


_weeks = f"(SELECT center, cast(floor({_days} / 7) AS int) AS week, {_phase_s} AS direction, avg(coherence) AS collective FROM {PAIR_DAY_SQL} p GROUP BY 1, 2)"
_rotation = {"center": "center", "week": "week", "direction": r("direction", 5), "collective": r("collective"), "turn": r("turn", 5), "sampled": "k % 4 = 1"}


@query(f"""SELECT {', '.join(f'{v} AS {k}' for k, v in _rotation.items())} FROM (SELECT *, d + pi() - 2 * pi() * floor((d + pi()) / (2 * pi())) - pi() AS turn FROM (
    SELECT *, direction - lag(direction) OVER w AS d, row_number() OVER w AS k FROM {_weeks} q WINDOW w AS (PARTITION BY center ORDER BY week)) z) y""")
def network_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction of the weekly mean phase, its wrapped change from week to week and every fourth week."""
    from meshlag.operators.series import wrapped_step

    p = pair_day(spark, sf_dir, False).withColumn("week", F.floor(F.datediff("date", F.lit("2000-01-01").cast("date")) / 7).cast("int"))
    weekly = p.groupBy("center", "week").agg(F.expr(_phase_s).alias("direction"), F.avg("coherence").alias("collective"))
    turned = wrapped_step(weekly, ["center"], "week", "direction")
    return turned.withColumn("k", F.row_number().over(Window.partitionBy("center").orderBy("week"))).transform(lambda df: select(df, _rotation))


@query(f"SELECT {geo.kp_class('kp_index')} AS activity, count(*) AS days, {r('avg(m)')} AS mean_coherence, {r('stddev_samp(m)')} AS sd FROM {DAILY_SQL} d JOIN {EXTERNAL_SQL} x ON x.date = d.date GROUP BY 1")
def activity_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir).join(external_daily(spark, sf_dir), "date")
    return d.groupBy(F.expr(geo.kp_class("kp_index")).alias("activity")).agg(F.count("*").alias("days"), F.expr(r("avg(m)")).alias("mean_coherence"), F.expr(r("stddev_samp(m)")).alias("sd"))


_speed = geo.orbital("doy")["orbital_speed"]
_tracked = {"windows": "count(*)", "r_speed": r("corr(ratio, speed)", 5), "mean_ratio": r("avg(ratio)", 5)}
_mean = lambda c: f"avg(CASE WHEN cls = '{c}' THEN coherence + 2 END)"  # noqa: E731  shifted, so that no ratio meets zero


@query(f"""SELECT {', '.join(f'{v} AS {k}' for k, v in _tracked.items())} FROM (SELECT centre, {_mean('EW')} / {_mean('NS')} AS ratio, any_value({_speed}) AS speed FROM (
    SELECT centre, coherence, cls, dayofyear(date '1995-01-01' + centre) AS doy FROM (SELECT coherence, {_ew} AS cls, date_diff('day', date '1995-01-01', date) AS d, cast(round(date_diff('day', date '1995-01-01', date) / 10.0) * 10 AS int) AS centre FROM {PAIR_DAY_SQL} p) p WHERE abs(d - centre) <= 2) q GROUP BY centre) z WHERE ratio IS NOT NULL""")
def orbital_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """East-west over north-south coherence in five days every ten, against the speed on the yearly orbit."""
    p = pair_day(spark, sf_dir).select("coherence", F.expr(_ew).alias("cls"), F.datediff("date", F.lit("1995-01-01").cast("date")).alias("d"))
    near = p.withColumn("centre", (F.round(F.col("d") / 10) * 10).cast("int")).where("abs(d - centre) <= 2")
    by = near.groupBy("centre").agg(F.expr(f"{_mean('EW')} / {_mean('NS')}").alias("ratio")).where("ratio IS NOT NULL")
    by = by.withColumn("doy", F.dayofyear(F.date_add(F.lit("1995-01-01").cast("date"), F.col("centre")))).withColumn("speed", F.expr(_speed))
    return by.agg(*[F.expr(v).alias(k) for k, v in _tracked.items()])


_beats = f"(SELECT DISTINCT round(1 / f, 4) AS period FROM (SELECT a.f + b.f AS f FROM {_freq} a JOIN {_freq} b ON a.id < b.id UNION ALL SELECT abs(a.f - b.f) FROM {_freq} a JOIN {_freq} b ON a.id < b.id) q WHERE 1 / f >= 7 AND (SELECT max(l_shipdate::date) - min(l_shipdate::date) FROM lineitem) * f >= 3)"


@query(f"SELECT period, {', '.join(r(c, 4) + ' AS ' + c for c in ('amplitude', 'level', 'r2'))}, n FROM " + fit.fit_harmonic_sql(f"(SELECT period, m AS y, 2 * pi() * (((dd / period) % 1 + 1) % 1) AS ph FROM (SELECT m, {_days} AS dd FROM {DAILY_SQL} d) q, {_beats} t)", ["period"], "ph", "y") + " h")
def beat_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Harmonic fits of the daily coherence at every beat of `beat_table`."""
    periods = beat_table(spark, sf_dir).select("period").distinct()
    d = daily(spark, sf_dir).select("m", F.datediff("date", F.lit("2000-01-01").cast("date")).alias("dd"))
    rows = d.join(F.broadcast(periods), F.lit(True)).withColumn("ph", F.expr("2 * pi() * (((dd / period) % 1 + 1) % 1)"))  # a dozen beats
    return select(fit.fit_harmonic(rows, ["period"], "ph", "m"), {"period": "period", "amplitude": r("amplitude", 4), "level": r("level", 4), "r2": r("r2", 4), "n": "n"})


_track = {"lat0": "m5 + CASE WHEN t < 0 THEN 8 * (t / 120.0D) ELSE -6 * (t / 120.0D) END", "lon0": "y5 + CASE WHEN t < 0 THEN 40 * (t / 120.0D) ELSE 50 * (t / 120.0D) END"}
_shade = f"greatest(0.0D, least(1.0D, 1 - {geo.great_circle('lat', 'lon', 'lat0', 'lon0')} / 2500))"
_shadow = {"event_id": "event_id", "minute": "t", "stations": "cast(sum(CASE WHEN mag > 0 THEN 1 ELSE 0 END) AS bigint)", "deepest": r("max(mag)"), "mean_magnitude": r("avg(mag)")}


@query(f"""SELECT {', '.join(f'{v} AS {k}' for k, v in _shadow.items())} FROM (SELECT event_id, t, {_shade} AS mag FROM (SELECT e.event_id, t, s.lat, s.lon, {', '.join(f'{v} AS {k}' for k, v in _track.items())} FROM (SELECT event_id, month(event_date) * 5 AS m5, year(event_date) % 360 - 180 AS y5 FROM {events_sql()} e) e, range(-120, 121, 20) r(t), {STATION_SQL} s) q) z GROUP BY event_id, t""")
def shadow_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shadow's centre between start, maximum and end by linear interpolation, and how deep each station lies in it."""
    e = events_calendar(spark, sf_dir).selectExpr("event_id", "month(event_date) * 5 AS m5", "year(event_date) % 360 - 180 AS y5").withColumn("t", F.explode(F.sequence(F.lit(-120), F.lit(120), F.lit(20))))
    e = e.selectExpr("event_id", "t", *[f"{v} AS {k}" for k, v in _track.items()])
    at = station(spark, sf_dir).join(F.broadcast(e), F.lit(True)).withColumn("mag", F.expr(_shade))  # a few hundred track points
    return at.groupBy("event_id", "t").agg(*[F.expr(v).alias(k) for k, v in _shadow.items() if k not in ("event_id", "minute")]).withColumnRenamed("t", "minute")
