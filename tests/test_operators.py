"""Algebraic identities, spectral equivalence, inference and series operators."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlag.functions.bins import accumulate, distance_bin, edges, finalise
from meshlag.functions.cut import cut
from meshlag.operators import resample, series, spectral, stats


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(k, k % 5, 5 + k % 4, datetime.date(2024, 1, 1 + k % 7), 60.0 + 37 * k % 9000, math.cos(k)) for k in range(400)]
    return spark.createDataFrame(rows, "row long, i long, j long, date date, dist_km double, coherence double").withColumn("bin", distance_bin("dist_km")).cache()


def test_edges_decide(spark):
    e = edges()
    df = spark.createDataFrame([(x,) for x in e] + [(49.0,), (20000.0,), (e[5] + 1e-9,), (e[5] - 1e-9,)], "d double")
    left = [r["b"] for r in df.select(distance_bin("d").alias("b")).collect()]
    assert left[:40] == list(range(40)) and left[40] is None and left[41:] == [None, None, 5, 4]
    right = [r["b"] for r in df.select(distance_bin("d", closed="right").alias("b")).collect()]
    assert right[0] is None and right[1:41] == list(range(40))


def test_state_merges(pairs):
    whole = {r["bin"]: (r["n"], round(r["s1"], 9)) for r in accumulate(pairs, []).collect()}
    halves = accumulate(pairs.withColumn("h", F.col("row") % 3), ["h"]).groupBy("bin").agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"))
    assert whole == {r["bin"]: (r["n"], round(r["s1"], 9)) for r in halves.collect()}


def test_leave_out_equals_refilter(pairs):
    got = resample.leave_out(cut(resample.by_station(pairs)), "station", 2)
    for s in (0, 7):
        direct = {r["bin"]: r for r in accumulate(pairs.where(f"i <> {s} AND j <> {s}"), []).collect()}
        mine = {r["bin"]: r for r in got.where(f"station = {s}").collect()}
        assert direct.keys() == mine.keys()
        for b, r in direct.items():
            assert mine[b]["n"] == r["n"]
            assert mine[b]["s1"] == pytest.approx(r["s1"], abs=1e-9)


def test_leave_out_by_either_end(pairs):
    """Totals and parts from one scan: a pair inside one group counts once, one between two in both."""
    grouped = pairs.withColumns({"g_i": F.col("i") % 3, "g_j": F.col("j") % 3})
    totals, parts = resample.by_either_end(grouped, "g_i", "g_j", "g")
    for g in (0, 2):
        direct = {r["bin"]: r for r in accumulate(grouped.where(f"g_i <> {g} AND g_j <> {g}"), []).collect()}
        mine = {r["bin"]: r for r in resample.leave_out(parts, "g", totals=totals).where(f"g = {g}").collect()}
        assert direct.keys() == mine.keys() and all(mine[b]["n"] == r["n"] and mine[b]["s1"] == pytest.approx(r["s1"], abs=1e-9) for b, r in direct.items())


def test_weighted_percentile(spark):
    rows = [(k % 3, float((k * 37) % 50) if k % 11 else None, 1.0 + k % 7) for k in range(400)]
    got = {r["g"]: r["percentile"] for r in stats.weighted_percentile(spark.createDataFrame(rows, "g int, v double, w double"), ["g"], "v", "w", 0.75).collect()}
    for g in range(3):
        own = sorted((v, w) for h, v, w in rows if h == g and v is not None)
        total, run = sum(w for _, w in own), 0.0
        want = next(v for v, w in own if (run := run + w) >= 0.75 * total)
        assert got[g] == want


def test_shuffled_rank(spark):
    df = spark.createDataFrame([((k * 7919) % 500, k) for k in range(500)], "v int, k int")
    assert [r["r"] for r in resample.shuffled_rank(df, ["v", "k"], "r").orderBy("v", "k").collect()] == list(range(1, 501))
    assert resample.shuffled_rank(df.limit(0), ["v"], "r").count() == 0


def test_small(spark):
    from meshlag.functions import cut as module

    plan = lambda df: df.join(module.small(df), "id")._jdf.queryExecution().analyzed().toString()
    few = spark.range(10)
    assert "broadcast" in plan(few)
    assert "broadcast" not in plan(spark.range(module.SMALL_ROWS + 1))


def test_permutation_keeps_values(pairs):
    p = resample.permute(pairs.select("row", "dist_km"), "row", "dist_km", 42).collect()
    before = [r["dist_km"] for r in pairs.orderBy("row").collect()]
    after = [r["dist_km"] for r in sorted(p, key=lambda r: r["row"])]
    assert sorted(before) == sorted(after) and before != after


def test_relabel_is_a_bijection(pairs):
    m = resample.relabel_by_day(pairs, 1).collect()
    for day in {r["date"] for r in m}:
        own = [r for r in m if r["date"] == day]
        assert sorted(r["s"] for r in own) == sorted(r["t"] for r in own)


def test_finalise(pairs):
    rows = finalise(accumulate(pairs, []), 5).collect()
    assert rows and all(r["n"] >= 5 and r["std_coherence"] >= 0 for r in rows)


def test_spectra_agree_with_fft(spark):
    rng = np.random.default_rng(3)
    rows = [(1, s, e, float(rng.normal() + 0.01 * e)) for s in (0, 1, 2) for e in range(64) if not (s == 2 and e % 9 == 4)]
    obs = spark.createDataFrame(rows, "blk long, st long, e long, bias double")
    got = {(r["i"], r["j"]): r for r in spectral.phases(obs, ["blk"], 16, [1, 2, 3], 16).collect()}
    assert set(got) == {(0, 1), (0, 2), (1, 2)}
    x = {s: {e: v for _, t, e, v in rows if t == s} for s in (0, 1, 2)}
    for (i, j), r in got.items():
        common = sorted(x[i].keys() & x[j].keys())
        a, b = (np.array([x[s][e] for e in common]) for s in (i, j))
        t = np.arange(len(common))
        a, b = a - np.polyval(np.polyfit(t, a, 1), t), b - np.polyval(np.polyfit(t, b, 1), t)
        w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(16) / 16)
        total = 0
        for k in range(0, len(t) - 15, 8):
            p, q = a[k : k + 16], b[k : k + 16]
            total = total + (np.conj(np.fft.rfft((p - p.mean()) * w)) * np.fft.rfft((q - q.mean()) * w))[[1, 2, 3]]
        assert r["n_epochs"] == len(common)
        assert r["phase"] == pytest.approx(np.angle(total.sum()), abs=1e-9)
        assert r["magnitude"] == pytest.approx(np.abs(total).mean(), rel=1e-9)


def test_band_indices():
    assert spectral.band_indices(30, 1024, 1e-5, 5e-4) == list(range(1, 16))
    assert spectral.band_indices(30, 240, 1e-5, 5e-4) == [1, 2, 3]


def test_corrections(spark):
    df = spark.createDataFrame([("a", "1", 0.01), ("a", "2", 0.02), ("b", "3", 0.03), ("b", "4", 0.9), ("b", "5", None)], "family string, name string, p_value double")
    out = {r["name"]: r for r in stats.correct(df).collect()}
    assert [round(out[k]["bh"], 9) for k in "1234"] == [0.04, 0.04, 0.04, 0.9]
    assert out["1"]["bonferroni"] == pytest.approx(0.04)
    assert out["1"]["family_bonferroni"] == pytest.approx(0.02)
    assert "5" not in out


def test_tails():
    assert stats.t_p_value(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert stats.beta_tail(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-9)
    assert stats.t_p_value(0.0, 5) == pytest.approx(1)
    assert stats.t_p_value(None, 5) is None


def test_series(spark):
    n = 50
    t = np.cumsum(np.random.default_rng(1).integers(1, 4, n)).astype(float)
    y = np.sin(t / 7)
    phase = np.angle(np.exp(1j * t / 3))
    df = spark.createDataFrame([("a", float(a), float(b), float(c)) for a, b, c in zip(t, y, phase, strict=True)], "k string, t double, y double, p double")
    g = [r["gradient"] for r in series.gradient(df, ["k"], "t", "y").orderBy("t").collect()]
    assert g == pytest.approx(np.gradient(y, t), abs=1e-9)
    u = [r["unwrapped"] for r in series.unwrap(df, ["k"], "t", "p").orderBy("t").collect()]
    assert u == pytest.approx(np.unwrap(phase), abs=1e-9)
    m = [r["median"] for r in series.rolling_median(df, ["k"], "t", "y").orderBy("t").collect()]
    assert m[0] is None and m[10] == pytest.approx(np.median(y[9:12]))
    assert sum(series.savgol_weights()) == pytest.approx(1)


def test_harmonics_are_removed(spark):
    df = spark.createDataFrame([("a", k, math.sin(2 * math.pi * k / 10) + 3) for k in range(60)], "k string, t int, y double")
    out = series.remove_harmonics(df, ["k"], "t", "y", [10.0])
    assert max(abs(r["residual"]) for r in out.collect()) < 1e-9
    h = series.instantaneous_period(df, ["k"], "t", "y", 5, 20).where("t BETWEEN 15 AND 45").collect()
    assert np.nanmedian([r["period"] for r in h]) == pytest.approx(10, rel=0.05)


def test_lag(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=200)
    a = spark.createDataFrame([(1, k, float(v[k])) for k in range(200)], "k int, t int, y double")
    b = spark.createDataFrame([(1, k + 5, float(v[k])) for k in range(200)], "k int, t int, y double")
    best = series.cross_correlation(a, b, ["k"], "t", "y", 10).orderBy(F.desc("r")).first()
    assert best["lag"] == 5 and best["r"] > 0.99


def test_whole_wavelets(spark, sf_dir):
    """All centres, days and scales; the series form equals the fan-out form."""
    from meshlag.plans import daily_series as d

    s = d.by_center(spark, sf_dir)
    got = {(r["center"], r["scale"], r["t"]): r["power"] for r in d.wavelet_spectrogram(spark, sf_dir).collect()}
    days = {(r["center"], r["t"]) for r in s.collect()}
    assert set(got) == {(c, scale, t) for c, t in days for scale in d.LONG_SCALES} and len({c for c, _ in days}) == 3 and max(t for _, t in days) > 2000
    want = d.series.morlet_power(s, ["center"], "t", "m", [20.0, 200.0]).collect()
    assert all(abs(got[r["center"], r["scale"], r["t"]] - r["power"]) < 1.1e-5 * max(1, r["power"]) for r in want)  # the query rounds to 5 digits
    assert {(r["center"], r["t"]) for r in d.on_off_days(spark, sf_dir).collect()} == days


def test_resolved_names(spark, sf_dir):
    """All suppliers resolve to themselves; customers are unknown."""
    from meshlag.plans.inference import resolved_names

    got = {r["name"]: r["resolved"] for r in resolved_names(spark, sf_dir).collect()}
    suppliers = {r[0] for r in spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_name").collect()}
    customers = {r[0] for r in spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_name").collect()}
    assert got == {**dict.fromkeys(customers), **{s: s for s in suppliers}}


def test_nulls_permute(spark, sf_dir):
    """Each iteration holds the very phases and distances, in another order; all three nulls are summarised."""
    from collections import Counter

    from meshlag.config import DEFAULT
    from meshlag.operators import resample
    from meshlag.plans import resampling

    center = lambda k: "A" if k % 5 == 0 else "B"
    skewed = spark.createDataFrame([(k, center(k), k, float(k % 7 == 0) + (center(k) == "A") * 10) for k in range(300)], "row long, center string, place long, phase double")
    out = resample.permute_each(skewed, "row", "phase", 3, "center").collect()
    orders = set()
    for it in (1, 2, 3):
        rows = sorted((r["row"], r["place"], r["phase"]) for r in out if r["iteration"] == it)
        assert [r[:2] for r in rows] == [(k, k) for k in range(300)]
        for c in "AB":  # values stay in their centre
            assert Counter(r[2] for r in rows if center(r[0]) == c) == Counter(float(k % 7 == 0) + (c == "A") * 10 for k in range(300) if center(k) == c)
        orders.add(tuple(r[2] for r in rows))
    assert len(orders) == 3
    pairs = spark.createDataFrame([("d", 1, 2), ("d", 3, 4), ("e", 1, 5)], "date string, i int, j int")
    moved = resample.relabel_each(pairs, 4, ["date"]).collect()
    for it in range(1, 5):
        for date, have in (("d", [1, 2, 3, 4]), ("e", [1, 5])):
            now = [r for r in moved if (r["iteration"], r["date"]) == (it, date)]
            assert sorted(r["s"] for r in now) == sorted(r["t"] for r in now) == have
    assert (DEFAULT.bootstrap, DEFAULT.bootstrap_block, DEFAULT.null_iterations) == (1000, 10, 100)
    rows = resampling.null_summary(spark, sf_dir, 2).collect()
    assert {(r["center"], r["null"]): r["iterations"] for r in rows} == {(c, k): 2 for c in "ANR" for k in ("distance", "phase", "station")}
    assert all(r["passes"] == (r["p_value"] < 0.05) for r in rows)


def test_sufficient_folds(spark):
    states = spark.createDataFrame([(1, 0, 50), (1, 1, 60), (2, 0, 900), (3, 0, 5)], "fold int, bin int, n long")
    got = {r["fold"]: (r["n_train"], r["n_held"], r["sufficient"]) for r in resample.sufficient(states, "fold", 200, 100).collect()}
    assert got == {1: (905, 110, True), 2: (115, 900, False), 3: (1010, 5, False)}


def test_row_sample(spark):
    df = spark.range(20_000)
    a = {r["id"] for r in resample.row_sample(df, "id", 0.1, 1).collect()}
    assert a == {r["id"] for r in resample.row_sample(df.repartition(7), "id", 0.1, 1).collect()} and 1800 < len(a) < 2200
    assert a != {r["id"] for r in resample.row_sample(df, "id", 0.1, 2).collect()} and resample.row_sample(df, "id", 0.0, 1).count() == 0


def test_bands_and_peaks(spark):
    rows = [(t, float(p), float((p * 7 + t) % 11)) for t in range(3) for p in range(10, 60, 5)]
    df = spark.createDataFrame(rows, "t int, period double, power double")
    bands = {(r["t"], r["target"]): r["band_power"] for r in series.band_power(df, ["t"], "period", "power", (20.0, 500.0)).collect()}
    peaks = {r["t"]: r["peak_period"] for r in series.stable_peak(df, ["t"], "period", "power", 2).collect()}
    for t in range(3):
        own = [(p, w) for u, p, w in rows if u == t]
        assert bands[t, 20.0] == pytest.approx(np.mean([w for p, w in own if 16 <= p <= 24]))
        top = max(range(len(own)), key=lambda k: (own[k][1], -k))
        near = own[max(0, top - 2) : top + 3]
        assert peaks[t] == pytest.approx(sum(p * w for p, w in near) / sum(w for _, w in near))
    assert len(bands) == 3


def test_block_bootstrap_finds_a_line(spark):
    """A strong line is rare among resampled blocks, noise is not; the power is that of a direct transform."""
    rng = np.random.default_rng(4)
    y = {"line": 2 * np.cos(2 * np.pi * np.arange(200) / 50) + 0.3 * rng.standard_normal(200), "noise": rng.standard_normal(200)}
    df = spark.createDataFrame([(k, i, float(v), 200) for k, x in y.items() for i, v in enumerate(x)], "center string, idx long, y double, n long")
    got = {(r["center"], r["line"]): r for r in series.block_bootstrap_p(df, ["center"], "idx", "y", "n", (50.0, 9.0), 3, 14, 60).collect()}
    assert got["line", 50.0]["p_value"] < 0.05 < got["noise", 50.0]["p_value"]
    for (k, period), r in got.items():
        i, x = np.arange(200), y[k] - y[k].mean()
        tapers = [np.sqrt(2 / 201) * np.sin(np.pi * t * (i + 1) / 201) for t in (1, 2, 3)]
        assert r["power"] == pytest.approx(np.mean([abs(np.sum(h * x * np.exp(2j * np.pi * i / period))) ** 2 for h in tapers]))


def test_models_together(spark):
    """Fitting several models in one job equals fitting them one by one."""
    from meshlag.operators import fit

    r = np.linspace(100, 9000, 25)
    rows = [(g, float(x), float(0.2 * np.exp(-x / (1500 + 900 * g)) - 0.01 + 0.003 * np.sin(x)), 100 + int(x) % 37) for g in range(2) for x in r]
    bins = spark.createDataFrame(rows, "g int, distance_km double, mean_coherence double, n int")
    names = ["exponential", "gaussian", "power_law", "matern_1_5"]
    both = {(x["g"], x["model"]): x for x in fit.fit_decay(bins, ["g"], names, errors=True).collect()}
    for m in names:
        for x in fit.fit_decay(bins, ["g"], m, errors=True).collect():
            for c in ("theta", "amplitude", "wrss", "aic", "se_theta"):
                assert both[x["g"], m][c] == pytest.approx(x[c], rel=1e-9)
            assert both[x["g"], m]["at_bound"] == x["at_bound"]


def test_evidence_classes(spark):
    from meshlag.plans.motion import evidence

    df = spark.createDataFrame([(0.9, 1e-5), (-0.6, 1e-3), (0.4, 0.04), (0.25, 0.9), (0.1, 1e-9), (0.65, 0.02)], "r double, p_value double")
    got = [[x[k] for x in df.selectExpr(*[f"{evidence(k)} AS {k}" for k in ("orbital", "wobble", "nutation")]).collect()] for k in ("orbital", "wobble", "nutation")]
    assert got == [["robust", "strong", "moderate", "weak", "none", "moderate"], ["robust", "significant", "identified", "none", "none", "identified"], ["robust", "identified", "none", "none", "none", "identified"]]


def test_block_draws(spark):
    """A replicate has as many bins as there are, in runs of neighbours."""
    from meshlag.plans import resampling

    for m in (4, 10, 16, 25):
        bins = spark.createDataFrame([("A", 3 * b) for b in range(m)], "center string, bin int")
        got = {}
        for x in resampling.block_draws(bins, 30, 10).collect():
            got.setdefault(x["replicate"], []).append(x["k"])
        assert len(got) == 30 and all(len(v) == m for v in got.values()) and all(0 <= k < m for v in got.values() for k in v)
        assert m <= 10 or len({tuple(sorted(v)) for v in got.values()}) > 5


def test_bitmaps(spark):
    """A bit is set exactly where one of the draws of its replicate hits the name."""
    import hashlib

    from meshlag.operators import resample

    names, replicates = [f"s{k:02}" for k in range(17)], 130
    df = spark.createDataFrame([(n,) for n in names * 2], "st string")
    got = {x["st"]: resample.unpacked(np.array([x["bits"]]), replicates)[0].tolist() for x in resample.drawn_bitmaps(df, "st", replicates, "kind").collect()}
    pick = lambda b, k: int(hashlib.md5(f"kind#{b}#{k}".encode()).hexdigest()[:12], 16) % 17
    drawn = [{pick(b, k) for k in range(17)} for b in range(replicates)]
    assert got == {n: [int(r in drawn[b]) for b in range(replicates)] for r, n in enumerate(names)}
    share = np.mean([v for x in got.values() for v in x])
    assert abs(share - (1 - (16 / 17) ** 17)) < 0.03


def test_replicate_states(spark):
    """Vectors of weighted bin sums equal those of the copies; Poisson weights have mean and variance 1."""
    from meshlag.operators import resample

    seeds, rng = resample.poisson_seeds(40), np.random.default_rng(1)
    rows = [(k, "AB"[k % 2], int(rng.integers(0, 4)), float(rng.normal()), float(rng.uniform(50, 9000))) for k in range(3000)]
    df = spark.createDataFrame(rows, "row long, center string, bin int, coherence double, dist_km double")
    weigh = lambda b: resample.poisson_weights(np.asarray(b.column("row")), seeds)
    w = resample.poisson_weights(np.arange(3000), seeds)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05 and abs(np.corrcoef(w.T)[np.triu_indices(40, 1)]).max() < 0.1
    assert abs(np.corrcoef(w[:-1].ravel(), w[1:].ravel())[0, 1]) < 0.02
    got = {(x["center"], x["replicate"], x["bin"]): x for x in resample.replicate_states(df, "center", ["row"], weigh, 40).collect()}
    b, c, d, k = (np.array([x[i] for x in rows]) for i in (2, 3, 4, 1))
    for (center, replicate, at), x in got.items():
        v = w[:, replicate - 1] * ((b == at) & (k == center))
        assert (x["n"], x["s1"], x["s2"], x["sd"]) == pytest.approx((v.sum(), (v * c).sum(), (v * c * c).sum(), (v * d).sum()), abs=1e-6)
    assert len(got) == 2 * 40 * 4
    whole = resample.replicate_states(df, None, ["row"], weigh, 40).agg(F.sum("n")).first()[0]
    assert whole == w.sum() and resample.replicate_states(df.limit(0), "center", ["row"], weigh, 40).count() == 0


def test_resampled_days(spark, sf_dir):
    """Days are on where power passes the level."""
    from meshlag.plans import daily_series

    days = daily_series.on_off_days(spark, sf_dir, 3).collect()
    assert {r["center"] for r in days} == set("ANR") and all(r["on"] == (r["power"] > r["threshold"]) for r in days) and any(r["on"] for r in days)


def test_shuffled_places():
    """A shuffle moves every place of any size to a place of its own, by another way for each key, and evenly."""
    import numpy as np

    from meshlag.operators import resample

    for size in (1, 2, 3, 5, 64, 1000, 4097):
        keys = resample.shuffle_keys(3, 7, size)
        moved = [resample.shuffled_places(np.arange(size, dtype=np.uint64), size, k).tolist() for k in keys]
        assert all(sorted(m) == list(range(size)) for m in moved)
        assert size < 64 or moved[0] != moved[1] != moved[2]
    met = np.array([resample.shuffled_places(np.arange(12, dtype=np.uint64), 12, k) for k in resample.shuffle_keys(24_000, 1)])
    counts = np.stack([np.bincount(met[:, k].astype(int), minlength=12) for k in range(12)])
    assert abs(counts - 2000).max() < 250  # 5.8 standard deviations of a uniform draw


def test_permuted_states(spark):
    """Permuted bin sums keep a group's rows: each iteration meets all coherences and all distances, those outside the bins included."""
    from meshlag.operators import resample

    rows = [(k, "A" if k % 5 == 0 else "B", float(k % 11), 100.0 * (k % 3), (None, 3, 7)[k % 3]) for k in range(600)] + [(900, None, 1.0, 100.0, 3)]
    df = spark.createDataFrame(rows, "row long, center string, coherence double, dist_km double, bin int")
    seen = set()
    for most in (100, 1):  # by shuffled places, by ranks
        out = resample.permuted_states(df, "row", 4, "center", most=most).collect()
        assert {(r["center"], r["iteration"], r["bin"]) for r in out} == {(c, it, b) for c in "AB" for it in range(1, 5) for b in (3, 7)}
        for r in out:
            n = sum(x[1] == r["center"] and x[4] == r["bin"] for x in rows)
            assert r["n"] == n and abs(r["sd"] - n * {3: 100.0, 7: 200.0}[r["bin"]]) < 1e-6
            assert abs(r["s1"] / n - 5) < 1.5
            seen.add((r["center"], r["bin"], round(r["s1"], 6)))
    assert len(seen) > 20
    even = spark.createDataFrame([(k, "A", float(k), 100.0, 3) for k in range(50)], "row long, center string, coherence double, dist_km double, bin int")
    got = resample.permuted_states(even, "row", 2, "center").collect()
    assert [(r["s1"], r["s2"], r["n"]) for r in got] == [(1225.0, 40425.0, 50)] * 2
    assert resample.permuted_states(even.where("row < 0"), "row", 2, "center").count() == 0


def test_relabelled_states(spark, sf_dir):
    """Sums of relabelled days equal those of the rows joined with the same labels."""
    from meshlag.operators import resample
    from meshlag.plans.fixtures import pair_day, pair_places

    p, places = pair_day(spark, sf_dir, False), pair_places(spark, sf_dir).select("i", "j", "dist_km", "bin").where("i % 7 <> 3")
    key = lambda r: (r["center"], r["iteration"], r["bin"], r["n"])
    got, want = (sorted(resample.relabelled_states(p, 3, ["center", "date"], places, most).collect(), key=key) for most in (10_000, 10))
    assert len(got) > 100 and [key(r) for r in got] == [key(r) for r in want]
    assert all(abs(a[c] - b[c]) < 1e-6 * max(1, abs(b[c])) for a, b in zip(got, want, strict=True) for c in ("s1", "s2", "sd"))
