"""Geodesy and scalar expressions, as SQL expression text that Spark evaluates inside code generation.

Each function returns text for `selectExpr` or `expr`. Arguments are column names or expressions.
"""

from __future__ import annotations

from meshlag.config import EARTH_KM, WGS84_A, WGS84_E2


def great_circle(lat1: str, lon1: str, lat2: str, lon2: str, radius: float = EARTH_KM) -> str:
    """Haversine distance in km; the argument of asin is kept within [0, 1]."""
    a = f"(pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians(({lon2}) - ({lon1})) / 2), 2))"
    return f"(2 * {radius} * asin(sqrt(least(1.0D, greatest(0.0D, {a})))))"


def chord(x1: str, y1: str, z1: str, x2: str, y2: str, z2: str) -> str:
    """Straight distance in km between two points in metres."""
    return f"(sqrt(pow(({x1}) - ({x2}), 2) + pow(({y1}) - ({y2}), 2) + pow(({z1}) - ({z2}), 2)) / 1000)"


def azimuth(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Initial bearing in degrees, 0 <= azimuth < 360."""
    y = f"sin(radians(({lon2}) - ({lon1}))) * cos(radians({lat2}))"
    x = f"cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos(radians(({lon2}) - ({lon1})))"
    return f"((degrees(atan2({y}, {x})) + 360) % 360)"


def sector(az: str) -> str:
    """Compass sector 0 (N) to 7 (NW)."""
    return f"cast(floor((({az}) + 22.5) / 45) % 8 AS int)"


def compass_class(az: str) -> str:
    """EW for 45..135 and 225..315 inclusive, else NS."""
    return f"CASE WHEN ({az}) BETWEEN 45 AND 135 OR ({az}) BETWEEN 225 AND 315 THEN 'EW' ELSE 'NS' END"


def longitude_gap(lon1: str, lon2: str) -> str:
    """Difference of two longitudes along the shorter way, 0..180."""
    return f"least(abs(({lon2}) - ({lon1})), 360 - abs(({lon2}) - ({lon1})))"


def local_hour(utc_hour: str, lon: str) -> str:
    """Local solar hour, 0 <= hour < 24."""
    return f"((((({utc_hour}) + ({lon}) / 15) % 24) + 24) % 24)"


def middle_longitude(lon1: str, lon2: str) -> str:
    """Circular mean of two longitudes."""
    return f"degrees(atan2(sin(radians({lon1})) + sin(radians({lon2})), cos(radians({lon1})) + cos(radians({lon2}))))"


def region(lon: str) -> str:
    """Region of a middle longitude; the Pacific is tested first, so none of it is lost."""
    return f"CASE WHEN ({lon}) > 150 OR ({lon}) < -150 THEN 'Pacific' WHEN ({lon}) >= 60 THEN 'Asia' WHEN ({lon}) >= -30 THEN 'Europe' ELSE 'Americas' END"


def season(month: str) -> str:
    return f"CASE WHEN ({month}) IN (12, 1, 2) THEN 'DJF' WHEN ({month}) <= 5 THEN 'MAM' WHEN ({month}) <= 8 THEN 'JJA' ELSE 'SON' END"


def cycle_phase(days: str, period: float) -> str:
    """Phase of a cycle in [0, 2 pi)."""
    return f"(2 * pi() * ((((({days}) / cast({period} AS double)) % 1) + 1) % 1))"


def geodetic_to_ecef(lat: str, lon: str, h: str) -> dict[str, str]:
    n = f"({WGS84_A} / sqrt(1 - {WGS84_E2!r} * pow(sin(radians({lat})), 2)))"
    return {
        "x": f"({n} + ({h})) * cos(radians({lat})) * cos(radians({lon}))",
        "y": f"({n} + ({h})) * cos(radians({lat})) * sin(radians({lon}))",
        "z": f"({n} * (1 - {WGS84_E2!r}) + ({h})) * sin(radians({lat}))",
    }


def ecef_to_geodetic(x: str, y: str, z: str, rounds: int = 5) -> list[dict[str, str]]:
    """Steps of columns: fixed-point latitude, then degrees and height; near the poles the height is along z."""
    p = f"sqrt(({x}) * ({x}) + ({y}) * ({y}))"
    steps = [{"p_": p}, {"lat_0": f"atan2({z}, p_ * (1 - {WGS84_E2!r}))"}]
    for k in range(rounds):
        n = f"({WGS84_A} / sqrt(1 - {WGS84_E2!r} * pow(sin(lat_{k}), 2)))"
        h = f"(CASE WHEN abs(cos(lat_{k})) > 1e-10 THEN p_ / cos(lat_{k}) - {n} ELSE abs({z}) - {n} * (1 - {WGS84_E2!r}) END)"
        steps.append({f"h_{k + 1}": h})
        steps.append({f"lat_{k + 1}": f"CASE WHEN p_ > 1e-9 THEN atan2({z}, p_ * (1 - {WGS84_E2!r} * {n} / ({n} + h_{k + 1}))) ELSE lat_{k} END"})
    steps.append({"lat_out": f"degrees(lat_{rounds})", "lon_out": f"degrees(atan2({y}, {x}))", "height_out": f"h_{rounds}"})
    return steps


def ecef_closed_form(x: str, y: str, z: str) -> list[dict[str, str]]:
    """Bowring's closed form, as steps of columns."""
    b = WGS84_A * (1 - WGS84_E2) ** 0.5
    ep2 = (WGS84_A**2 - b**2) / b**2
    return [
        {"p_c": f"sqrt(({x}) * ({x}) + ({y}) * ({y}))"},
        {"beta_c": f"atan2(({z}) * {WGS84_A}, p_c * {b!r})"},
        {"rad_c": f"atan2(({z}) + {ep2 * b!r} * pow(sin(beta_c), 3), p_c - {WGS84_E2 * WGS84_A!r} * pow(cos(beta_c), 3))"},
        {"lat_closed": "degrees(rad_c)", "lon_closed": f"degrees(atan2({y}, {x}))", "height_closed": f"p_c / cos(rad_c) - {WGS84_A} / sqrt(1 - {WGS84_E2!r} * pow(sin(rad_c), 2))"},
    ]


def solar_zenith(lat: str, lon: str, epoch_s: str) -> list[dict[str, str]]:
    """Steps of columns ending in zenith_deg (0 overhead, 90 at the horizon), low-precision solar position."""
    return [
        {"n_": f"(({epoch_s}) / 86400 + 2440587.5 - 2451545.0)"},
        {"l_": "radians((280.460 + 0.9856474 * n_) % 360)", "g_": "radians((357.528 + 0.9856003 * n_) % 360)"},
        {"ecl_": "l_ + radians(1.915D) * sin(g_) + radians(0.020D) * sin(2 * g_)"},
        {"dec_": "asin(sin(radians(23.439D)) * sin(ecl_))", "ha_": f"radians(15 * ((({epoch_s}) % 86400) / 3600 - 12) + ({lon}))"},
        {"zenith_deg": f"degrees(acos(greatest(-1.0D, least(1.0D, sin(radians({lat})) * sin(dec_) + cos(radians({lat})) * cos(dec_) * cos(ha_)))))"},
    ]


def orbital(day_of_year: str) -> dict[str, str]:
    """Distance factor and speed of the yearly orbit from the day of the year."""
    factor = f"(1 - 0.0167 * cos(2 * pi() * (({day_of_year}) - 4) / 365.25))"
    return {"distance_au": factor, "orbital_speed": f"29.78 / {factor}"}


def elevation(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Elevation of a pair's direction in degrees: asin(sin(dlat) / c), c the central angle; 0 for c = 0."""
    c = great_circle(lat1, lon1, lat2, lon2, 1.0)
    return f"CASE WHEN {c} > 0 THEN degrees(asin(greatest(-1.0D, least(1.0D, sin(radians(({lat2}) - ({lat1}))) / {c})))) ELSE 0.0D END"


def shadow_magnitude(distance_km: str) -> str:
    """Linear fall from 1 at the centre to 0 at 2500 km."""
    return f"greatest(0.0D, least(1.0D, 1 - ({distance_km}) / 2500))"


def eclipse_magnitude(distance_km: str) -> str:
    """Piecewise magnitude by distance from the centre line."""
    return f"CASE WHEN ({distance_km}) < 100 THEN 1.0D WHEN ({distance_km}) < 300 THEN 0.9D - (({distance_km}) - 100) / 200 * 0.3D WHEN ({distance_km}) < 500 THEN 0.6D - (({distance_km}) - 300) / 200 * 0.3D WHEN ({distance_km}) < 1000 THEN 0.3D - (({distance_km}) - 500) / 500 * 0.3D ELSE 0.0D END"


def eclipse_phase(minutes: str) -> str:
    return f"CASE WHEN ({minutes}) < -240 THEN 'baseline' WHEN ({minutes}) < -120 THEN 'before' WHEN ({minutes}) < -30 THEN 'beginning' WHEN ({minutes}) <= 30 THEN 'maximum' WHEN ({minutes}) <= 120 THEN 'ending' WHEN ({minutes}) <= 240 THEN 'after' ELSE 'recovery' END"


def kp_class(kp: str) -> str:
    """Right-closed classes; 0 and missing values have none."""
    return f"CASE WHEN ({kp}) > 0 AND ({kp}) <= 2 THEN 'quiet' WHEN ({kp}) > 2 AND ({kp}) <= 4 THEN 'unsettled' WHEN ({kp}) > 4 AND ({kp}) <= 6 THEN 'active' WHEN ({kp}) > 6 AND ({kp}) <= 9 THEN 'storm' END"


def kappa_from_mean_cosine(r: str) -> str:
    """Concentration of a von Mises distribution from its mean resultant length, piecewise."""
    return f"CASE WHEN ({r}) < 0.53 THEN 2 * ({r}) + pow({r}, 3) + 5 * pow({r}, 5) / 6 WHEN ({r}) < 0.85 THEN -0.4 + 1.39 * ({r}) + 0.43 / (1 - ({r})) ELSE 1 / (pow({r}, 3) - 4 * pow({r}, 2) + 3 * ({r})) END"


def gps_week(date: str) -> str:
    return f"cast(floor(datediff({date}, date'1980-01-06') / 7) AS int)"
