"""Station geometry, coordinates, local time, regions: G1-G22, J2-J4, A22, A25, A26."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlag.functions import geo
from meshlag.operators.steps import apply, nest
from meshlag.plans.fixtures import PAIR_DAY_SQL, STATION_SQL, events_calendar, pair_day, read, station
from meshlag.plans.registry import cols, query, r, select

AZ = geo.azimuth("lat_i", "lon_i", "lat_j", "lon_j")
ALL_PAIRS = f"(SELECT a.id AS i, b.id AS j, a.lat AS lat_i, a.lon AS lon_i, b.lat AS lat_j, b.lon AS lon_j, a.height_m AS h_i, b.height_m AS h_j FROM {STATION_SQL} a JOIN {STATION_SQL} b ON a.id < b.id)"


def all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of stations, i < j: the dimension of places is small and broadcast by its size."""
    s = station(spark, sf_dir)
    a = s.select(F.col("id").alias("i"), F.col("lat").alias("lat_i"), F.col("lon").alias("lon_i"), F.col("height_m").alias("h_i"))
    b = s.select(F.col("id").alias("j"), F.col("lat").alias("lat_j"), F.col("lon").alias("lon_j"), F.col("height_m").alias("h_j"))
    return a.join(b, F.col("i") < F.col("j"))


_matrix = {"i": "i", "j": "j", "dist_km": r(geo.great_circle("lat_i", "lon_i", "lat_j", "lon_j")), "dist_round": r(geo.great_circle("lat_i", "lon_i", "lat_j", "lon_j", 6371.0))}


@query(f"SELECT {cols(_matrix)} FROM {ALL_PAIRS} p")
def station_distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(all_pairs(spark, sf_dir), _matrix)


_dir = {"i": "i", "j": "j", "azimuth": r(AZ), "sector": geo.sector(f"round({AZ}, 9)"), "compass": geo.compass_class(f"round({AZ}, 9)"), "lon_gap": r(geo.longitude_gap("lon_i", "lon_j")), "hour_gap": r(f"{geo.longitude_gap('lon_i', 'lon_j')} / 15"), "elevation_deg": r(geo.elevation("lat_i", "lon_i", "lat_j", "lon_j")), "region": geo.region(f"round({geo.middle_longitude('lon_i', 'lon_j')}, 6)")}


@query(f"SELECT {cols(_dir)} FROM {ALL_PAIRS} p")
def pair_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(all_pairs(spark, sf_dir), _dir)


_ecef = [geo.geodetic_to_ecef("lat", "lon", "height_m"), *geo.ecef_to_geodetic("x", "y", "z"), *geo.ecef_closed_form("x", "y", "z")]
_ecef_out = {"id": "id", "x": r("x", 4), "y": r("y", 4), "z": r("z", 4), "lat_iterated": r("lat_out", 7), "lon_iterated": r("lon_out", 7), "height_iterated": r("height_out", 3), "lat_bowring": r("lat_closed", 7), "height_bowring": r("height_closed", 3)}


@query(f"SELECT {cols(_ecef_out)} FROM {nest(STATION_SQL, _ecef)} g")
def coordinate_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(apply(station(spark, sf_dir), _ecef), _ecef_out)


_chord = geo.chord("x_i", "y_i", "z_i", "x_j", "y_j", "z_j")
_xyz = geo.geodetic_to_ecef("lat", "lon", "height_m")


@query(f"SELECT a.id AS i, b.id AS j, {r(geo.chord('a.x', 'a.y', 'a.z', 'b.x', 'b.y', 'b.z'), 4)} AS chord_km FROM {nest(STATION_SQL, [_xyz])} a JOIN {nest(STATION_SQL, [_xyz])} b ON a.id < b.id")
def chord_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = apply(station(spark, sf_dir), [_xyz])
    a, b = (s.select(F.col("id").alias(e), *[F.col(c).alias(f"{c}_{e}") for c in "xyz"]) for e in "ij")
    return select(a.join(b, F.col("i") < F.col("j")), {"i": "i", "j": "j", "chord_km": r(_chord, 4)})


_zen = geo.solar_zenith("lat", "lon", "epoch_s")
_zen_out = {"event_id": "event_id", "zenith_deg": r("zenith_deg", 4), "is_day": "round(zenith_deg, 4) < 90"}


@query(f"""SELECT {cols(_zen_out)} FROM {nest(f"(SELECT e.event_id, s.lat, s.lon, floor(epoch_us(e.ts) / 1000000) AS epoch_s FROM events e JOIN {STATION_SQL} s ON s.id = e.user_id % 40)", _zen)} z""")
def event_solar_zenith(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 40).alias("id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("epoch_s"))
    return select(apply(e.join(station(spark, sf_dir), "id"), _zen), _zen_out)


_hour = geo.local_hour("h", "lon")


@query(f"""SELECT {geo.season('m')} AS season, cast(floor(round({_hour}, 6)) AS int) % 24 AS local_hour, count(*) AS n, {r('avg(value)')} AS mean_value
    FROM (SELECT e.value, s.lon, month(e.ts) AS m, hour(e.ts) AS h FROM events e JOIN {STATION_SQL} s ON s.id = e.user_id % 40) q GROUP BY 1, 2""")
def local_hour_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").selectExpr("value", "user_id % 40 AS id", "month(ts) AS m", "hour(ts) AS h").join(station(spark, sf_dir), "id")
    keyed = e.selectExpr(f"{geo.season('m')} AS season", f"cast(floor(round({_hour}, 6)) AS int) % 24 AS local_hour", "value")
    return keyed.groupBy("season", "local_hour").agg(F.count("*").alias("n"), F.expr(r("avg(value)")).alias("mean_value"))


_orb = geo.orbital("doy")
_orb_out = {"date": "date", "distance_au": r(_orb["distance_au"], 8), "orbital_speed": r(_orb["orbital_speed"], 8), "year_phase": r(geo.cycle_phase("d", 365.25)), "long_phase": r(geo.cycle_phase("d", 433.0)), "week": "cast(floor(d2 / 7) AS int)", "season": geo.season("m")}


@query(f"SELECT {cols(_orb_out)} FROM (SELECT DISTINCT cast(l_shipdate AS date) AS date, dayofyear(l_shipdate) AS doy, month(l_shipdate) AS m, date_diff('day', date '2000-01-01', cast(l_shipdate AS date)) AS d, date_diff('day', date '1980-01-06', cast(l_shipdate AS date)) AS d2 FROM lineitem) q")
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = read(spark, sf_dir, "lineitem").selectExpr("cast(l_shipdate AS date) AS date").distinct()
    return select(days.selectExpr("date", "dayofyear(date) AS doy", "month(date) AS m", "datediff(date, date'2000-01-01') AS d", "datediff(date, date'1980-01-06') AS d2"), _orb_out)


_ecl = {"event_id": "event_id", "id": "id", "dist_km": r("dk", 3), "shadow": r(geo.shadow_magnitude("dk")), "magnitude": r(geo.eclipse_magnitude("dk")), "phase": geo.eclipse_phase("minutes")}
_track = "40 + 0.05 * (id % 7)"


@query(f"""SELECT {cols(_ecl)} FROM (SELECT event_id, s.id, (s.id * 25) % 700 - 350 AS minutes, {geo.great_circle('s.lat', 's.lon', 'c.lat0', 'c.lon0')} AS dk
    FROM (SELECT DISTINCT year(l_shipdate) * 100 + month(l_shipdate) AS event_id, cast(month(l_shipdate) * 5 AS double) AS lat0, cast(year(l_shipdate) % 360 - 180 AS double) AS lon0 FROM lineitem WHERE day(l_shipdate) = 15 AND month(l_shipdate) IN (3, 9)) c, {STATION_SQL} s) q""")
def eclipse_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = events_calendar(spark, sf_dir).selectExpr("event_id", "cast(month(event_date) * 5 AS double) AS lat0", "cast(year(event_date) % 360 - 180 AS double) AS lon0")
    grid = station(spark, sf_dir).join(F.broadcast(centres), F.lit(True))  # a handful of events against 40 places
    return select(grid.selectExpr("event_id", "id", "(id * 25) % 700 - 350 AS minutes", f"{geo.great_circle('lat', 'lon', 'lat0', 'lon0')} AS dk"), _ecl)


_audit = {
    "n": "count(*)", "lat_min": "min(lat)", "lat_max": "max(lat)", "lon_min": "min(lon)", "lon_max": "max(lon)", "lon_span": "max(lon) - min(lon)", "north": "sum(CASE WHEN lat > 0 THEN 1 ELSE 0 END)", "south": "sum(CASE WHEN lat < 0 THEN 1 ELSE 0 END)",
    "conjugate": "least(sum(CASE WHEN lat > 0 THEN 1 ELSE 0 END), sum(CASE WHEN lat < 0 THEN 1 ELSE 0 END))", "low": "sum(CASE WHEN height_m < 500 THEN 1 ELSE 0 END)", "middle": "sum(CASE WHEN height_m >= 500 AND height_m < 1500 THEN 1 ELSE 0 END)", "high": "sum(CASE WHEN height_m >= 1500 THEN 1 ELSE 0 END)",
    "coverage_pct": r("100 * avg(CASE WHEN abs(lat) <= 90 AND abs(lon) <= 180 AND NOT (lat = 0 AND lon = 0) THEN 1.0D ELSE 0.0D END)"), "radius_outliers": "sum(CASE WHEN abs(sqrt(x * x + y * y + z * z) - 6371000) > 25000 THEN 1 ELSE 0 END)",
}
_audit = {k: (f"cast({v} AS bigint)" if v.startswith(("sum", "least")) else v) for k, v in _audit.items()}


@query(f"SELECT {cols(_audit)} FROM {nest(STATION_SQL, [_xyz])} g")
def catalogue_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(station(spark, sf_dir), [_xyz]).agg(*[F.expr(v).alias(k) for k, v in _audit.items()])


_kappa = {"center": "center", "mean_cosine": r("mc"), "kappa": r(geo.kappa_from_mean_cosine("abs(mc)"))}


@query(f"SELECT {cols(_kappa)} FROM (SELECT center, avg(coherence) AS mc FROM {PAIR_DAY_SQL} p GROUP BY 1) q")
def concentration_by_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(pair_day(spark, sf_dir).groupBy("center").agg(F.avg("coherence").alias("mc")), _kappa)


@query(f"SELECT p.center, cast(floor(p.h_i / 500) AS int) AS band_i, cast(floor(p.h_j / 500) AS int) AS band_j, count(*) AS n, {r('avg(p.coherence)')} AS mean_coherence, {r('avg(abs(p.gm_i - p.gm_j))')} AS mean_gap FROM {PAIR_DAY_SQL} p GROUP BY 1, 2, 3")
def strata_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair_day(spark, sf_dir)
    return p.groupBy("center", F.floor(F.col("h_i") / 500).cast("int").alias("band_i"), F.floor(F.col("h_j") / 500).cast("int").alias("band_j")).agg(F.count("*").alias("n"), F.expr(r("avg(coherence)")).alias("mean_coherence"), F.expr(r("avg(abs(gm_i - gm_j))")).alias("mean_gap"))


_motion = [
    {"d": "datediff(date, date'2000-01-01')"},
    {"op": geo.cycle_phase("d", 365.25), "cp": geo.cycle_phase("d", 433.0)},
    {
        "centripetal": "abs(cos(radians(lat_j)) - cos(radians(lat_i))) * pow(2 * pi() / 86400, 2) * 6371000", "rotation_km_s": "abs(cos(radians(lat_j)) - cos(radians(lat_i))) * 2 * pi() / 86400 * 6371",
        "orbital_acc": "abs(cos(op + radians(lon_j)) - cos(op + radians(lon_i))) * (29780D * 29780D / 1.496e11)", "wobble_acc": "abs(abs(cos(radians(lat_j))) - abs(cos(radians(lat_i)))) * abs(sin(cp)) * pow(2 * pi() / (433D * 86400), 2) * 9",
        "orbital_wobble_gap": "abs(op - cp)", "distance_class": "CASE WHEN dist_km < 1000 THEN 'short' WHEN dist_km < 5000 THEN 'medium' ELSE 'long' END",
    },
    {"total_acc": "sqrt(centripetal * centripetal + orbital_acc * orbital_acc + wobble_acc * wobble_acc)", "in_step": "CASE WHEN orbital_wobble_gap < pi() / 4 THEN 'constructive' WHEN abs(orbital_wobble_gap - pi()) < pi() / 4 THEN 'destructive' ELSE 'mixed' END"},
]
_motion_out = {"distance_class": "distance_class", "in_step": "in_step", "n": "count(*)", "mean_total_acc": r("avg(total_acc)", 8), "mean_rotation": r("avg(rotation_km_s)"), "mean_coherence": r("avg(coherence)"), "corr_acc": r("corr(total_acc, coherence)", 5)}


@query(f"SELECT {cols(_motion_out)} FROM {nest(PAIR_DAY_SQL, _motion).replace('datediff(date, ', 'date_diff(' + chr(39) + 'day' + chr(39) + ', ').replace(chr(39) + '2000-01-01' + chr(39) + ')', chr(39) + '2000-01-01' + chr(39) + ', date)')} m GROUP BY distance_class, in_step")
def relative_motion_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = apply(pair_day(spark, sf_dir), _motion)
    out = {k: v for k, v in _motion_out.items() if k not in ("distance_class", "in_step")}
    return m.groupBy("distance_class", "in_step").agg(*[F.expr(v).alias(k) for k, v in out.items()])
