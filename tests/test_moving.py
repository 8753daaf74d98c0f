"""Passing shadows against a direct computation; pairs on their common epochs against a transform of each."""

import math

import numpy as np
import pytest

from meshlag.operators import moving, spectral


def haversine(lat1, lon1, lat2, lon2):
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1, max(0, a))))


EVENTS = [(1, 1_000_000, 120, 10.0, 20.0, 2.0, -20.0, 4.0, 70.0), (2, 1_005_000, 60, -30.0, 100.0, -35.0, 80.0, -28.0, 130.0), (3, 9_000_000, 120, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
PLACES = [(k, -40.0 + 11 * k, -30.0 + 23 * k) for k in range(8)] + [(8, 11.0, 22.0), (9, 9.0, 18.0)]


def centre(e, minute):
    _, _, reach, lat, lon, lat_a, lon_a, lat_b, lon_b = e
    f = min(1, abs(minute) / reach)
    to = (lat_a, lon_a) if minute < 0 else (lat_b, lon_b)
    return lat + (to[0] - lat) * f, lon + (to[1] - lon) * f


def depth(e, minute, place):
    return max(0.0, min(1.0, 1 - haversine(place[1], place[2], *centre(e, minute)) / 2500))


@pytest.fixture(scope="module")
def sky(spark):
    events = spark.createDataFrame(EVENTS, "event_id long, t0 long, reach int, lat_max double, lon_max double, lat_start double, lon_start double, lat_end double, lon_end double")
    return events, spark.createDataFrame(PLACES, "id long, lat double, lon double")


def test_shadow_pairs(spark, sky):
    events, places = sky
    rng = np.random.default_rng(3)
    obs = [(int(rng.integers(0, 10)), float(t), float(rng.normal(0, 50))) for t in rng.uniform(990_000, 1_012_000, 1500)] + [(3, 1_007_200.0, 1.0), (4, 1_007_200.5, 1.0), (77, 1_000_000.0, 5.0)]
    want = {}
    for e in EVENTS:
        means = {}
        for st, t, x in obs:
            if abs(t - e[1]) <= e[2] * 60 and st < 10:
                means.setdefault(math.floor((t - e[1]) / 60 / 20) * 20, {}).setdefault(st, []).append(x)
        for minute, found in means.items():
            if len(found) >= 4:
                for a in found:
                    for b in found:
                        if a < b:
                            inside = sum(depth(e, minute, PLACES[s]) > 0.1 for s in (a, b))
                            want.setdefault((e[0], minute, ("outside", "edge", "inside")[inside]), []).append(1 / (1 + abs(np.mean(found[a]) - np.mean(found[b])) / 100))
    want = {k: v for k, v in want.items() if len(v) > 1}
    rows = moving.shadow_pairs(spark.createDataFrame(obs, "st long, t double, bias double"), events, places, 20, 100.0, 4).collect()
    assert {(r["event_id"], r["minute"], r["class"]): (r["n"], pytest.approx(r["mean"]), pytest.approx(r["spread"], abs=1e-9)) for r in rows} == {k: (len(v), np.mean(v), np.std(v)) for k, v in want.items()}
    assert {k[2] for k in want} == {"inside", "edge", "outside"}
    assert moving.shadow_pairs(spark.createDataFrame(obs, "st long, t double, bias double").limit(0), events, places, 20, 100.0, 4).count() == 0


def test_deepest(sky):
    events, places = sky
    got = {(r["event_id"], r["id"]): r["mag"] for r in moving.deepest(events, places, 10).collect()}
    assert got == {(e[0], p[0]): pytest.approx(max(depth(e, m, p) for m in range(-e[2], e[2] + 1, 10))) for e in EVENTS for p in PLACES}


def test_in_windows(spark):
    obs = spark.createDataFrame([(t,) for t in range(-50, 500, 7)], "t long")
    events = spark.createDataFrame([(1, 0), (2, 30), (3, 400), (4, 405)], "event_id long, t0 long")
    got = {(r["event_id"], r["t"]) for r in moving.in_windows(obs, events, 21).collect()}
    assert got == {(k, t) for k, t0 in ((1, 0), (2, 30), (3, 400), (4, 405)) for t in range(-50, 500, 7) if abs(t - t0) <= 21}


def test_common_phases(spark):
    """Gaps at different epochs: every pair is measured on what both have, in their order; short pairs have no phase."""
    rng = np.random.default_rng(5)
    rows = [(b, st, e, float(np.sin(e / 3 + st) + 0.1 * rng.normal() + 0.02 * e)) for b in range(2) for st in range(4) for e in range(60) if (e * 7 + st * 3) % 5 or st == 0]
    rows += [(0, 9, e, 1.0 * e) for e in range(5)]
    obs = spark.createDataFrame(rows, "blk long, st long, e long, bias double")
    pairs = spark.createDataFrame([(b, i, j) for b in range(2) for i in (0, 1, 2) for j in (1, 2, 3) if i < j] + [(0, 0, 9)], "blk long, i long, j long")
    got = {(r["blk"], r["i"], r["j"]): r for r in spectral.common_phases(obs, ["blk"], pairs, 16, [1, 2, 3], 20).collect()}
    values = {}
    for b, st, e, x in rows:
        values.setdefault((b, st), {})[e] = x
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(16) / 16)
    for (b, i, j), r in got.items():
        common = sorted(values[b, i].keys() & values[b, j].keys())
        assert r["n_epochs"] == len(common)
        if j == 9:
            assert r["phase"] is None and r["magnitude"] is None
            continue
        t, total = np.arange(len(common)), np.zeros(3, complex)
        x, y = (v - np.polyval(np.polyfit(t, v, 1), t) for v in (np.array([values[b, s][e] for e in common]) for s in (i, j)))
        for at in range(0, len(common) - 15, 8):
            p, q = x[at : at + 16], y[at : at + 16]
            total += (np.conj(np.fft.rfft((p - p.mean()) * taper)) * np.fft.rfft((q - q.mean()) * taper))[1:4]
        assert np.exp(1j * r["phase"]) == pytest.approx(np.exp(1j * np.angle(total.sum())), abs=1e-6) and r["magnitude"] == pytest.approx(np.abs(total).mean(), rel=1e-6)
    assert len(got) == 13
