"""Expressions against hand-computed values."""

import math

import pytest

from meshlag.functions import geo
from meshlag.operators.steps import apply


def value(spark, text, **columns):
    df = spark.range(1).selectExpr(*[f"cast({v} AS double) AS {k}" for k, v in columns.items()]) if columns else spark.range(1)
    return df.selectExpr(f"{text} AS v").first()["v"]


def test_quarter_meridian(spark):
    assert value(spark, geo.great_circle("0D", "0D", "90D", "0D")) == pytest.approx(math.pi / 2 * 6371.0088, abs=1e-6)
    assert value(spark, geo.great_circle("0D", "0D", "0D", "0D")) == 0
    assert value(spark, geo.great_circle("0D", "-179D", "0D", "179D")) == pytest.approx(math.radians(2) * 6371.0088, abs=1e-6)


@pytest.mark.parametrize("lat, lon, az", [("1D", "0D", 0), ("0D", "1D", 90), ("-1D", "0D", 180), ("0D", "-1D", 270)])
def test_azimuth_and_sector(spark, lat, lon, az):
    text = geo.azimuth("0D", "0D", lat, lon)
    assert value(spark, text) == pytest.approx(az, abs=1e-9)
    assert value(spark, geo.sector(text)) == az // 45
    assert value(spark, geo.compass_class(text)) == ("EW" if az in (90, 270) else "NS")


def test_wraps(spark):
    assert value(spark, geo.longitude_gap("-179D", "179D")) == 2
    assert value(spark, geo.local_hour("1D", "-30D")) == 23
    assert abs(value(spark, geo.middle_longitude("170D", "-170D"))) == pytest.approx(180)
    assert value(spark, geo.region("-170")) == "Pacific"
    assert [value(spark, geo.season(str(m))) for m in (12, 3, 8, 11)] == ["DJF", "MAM", "JJA", "SON"]


@pytest.mark.parametrize("lat, lon, h", [(48.0, 11.0, 500.0), (-33.0, -70.0, 2000.0), (89.9, 45.0, 10.0), (0.0, 0.0, 0.0)])
def test_ecef_round_trip(spark, lat, lon, h):
    df = spark.createDataFrame([(lat, lon, h)], "lat double, lon double, h double")
    out = apply(df, [geo.geodetic_to_ecef("lat", "lon", "h"), *geo.ecef_to_geodetic("x", "y", "z"), *geo.ecef_closed_form("x", "y", "z")]).first()
    assert out["lat_out"] == pytest.approx(lat, abs=1e-8)
    assert out["lon_out"] == pytest.approx(lon, abs=1e-9)
    assert out["height_out"] == pytest.approx(h, abs=1e-2)
    assert out["lat_closed"] == pytest.approx(lat, abs=1e-8)


def test_pole_height(spark):
    df = spark.createDataFrame([(0.0, 0.0, 6356752.3142 + 100)], "x double, y double, z double")
    out = apply(df, geo.ecef_to_geodetic("x", "y", "z")).first()
    assert out["height_out"] == pytest.approx(100, abs=1e-3)
    assert out["lat_out"] == pytest.approx(90)


def test_piecewise(spark):
    assert [value(spark, geo.kp_class(k)) for k in ("0", "2", "2.1", "6", "9")] == [None, "quiet", "unsettled", "active", "storm"]
    assert value(spark, geo.eclipse_phase("-31")) == "beginning"
    assert value(spark, geo.eclipse_magnitude("50D")) == 1
    assert value(spark, geo.shadow_magnitude("1250D")) == 0.5
    assert value(spark, geo.kappa_from_mean_cosine("0D")) == 0


def test_zenith_at_noon(spark):
    # the sun stands near the zenith of (0, 0) at noon of an equinox
    noon = 1_710_936_000  # 2024-03-20 12:00
    df = spark.createDataFrame([(0.0, 0.0, noon)], "lat double, lon double, s long")
    assert apply(df, geo.solar_zenith("lat", "lon", "s")).first()["zenith_deg"] < 1
