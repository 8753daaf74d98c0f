"""Fits of three published bin tables, and of constructed ones."""

import math
import random

import pytest
from pyspark.sql import functions as F

from meshlag.operators import fit

# fixed values: published bins (distance in km, mean coherence, rows)
PUBLISHED = {
    "A": [
        (69.65614252685442, 0.08315594305559651, 6736),
        (95.56062748548177, 0.03467752506642524, 3656),
        (117.37609887013986, 0.06655566309629729, 11125),
        (142.6413489452046, 0.03548038233837241, 5600),
        (161.03698065478244, -0.07610822665175307, 13785),
        (184.08126053325546, 0.1407318633505269, 6295),
        (230.09864303520214, 0.1348800957534848, 39643),
        (284.81394753165597, 0.0665508897689754, 45185),
        (327.64434966790157, 0.157592553987729, 45506),
        (405.28975847384453, 0.07815986656146029, 123141),
        (540.3360842640437, 0.11434656271624027, 186183),
        (660.1857556183505, 0.08630143359428816, 136964),
        (753.2370994851999, 0.05616978682864903, 138850),
        (933.8483454699161, 0.05366227147999301, 460178),
        (1141.563322867433, 0.05257272664947036, 317828),
        (1309.7357357742446, 0.06910979053012775, 322744),
        (1507.2976309292017, 0.06951078867483422, 332609),
        (1873.5858565719006, 0.052709561079604055, 927732),
        (2289.511185188889, 0.0465657342215941, 565609),
        (2639.424091208311, 0.05025445375579901, 568379),
        (3272.2231180878643, 0.03138765011613335, 1543834),
        (4001.4285288099277, 0.03652030284559135, 980831),
        (4965.464333728694, 0.014039112106989509, 2937003),
        (6081.731059568994, 0.008274830786489083, 2008869),
        (6989.348856712611, 0.005653365012772612, 2563629),
        (8022.0897284877465, -0.0009794045367294757, 3888575),
        (9814.301972907011, -0.010390933623667113, 8009391),
        (12147.893259429555, -0.010903147013211266, 3849597),
    ],
    "B": [
        (70.53730707922529, 0.07539237453371966, 1053),
        (95.44462320376682, 0.022455856514876426, 533),
        (112.65090819450201, -0.08075149073496533, 2420),
        (144.5581275169827, 0.12785591701362575, 1320),
        (162.0840638922324, 0.09162846148519663, 852),
        (190.09930254557366, 0.14312872225219248, 1448),
        (225.30255531818008, 0.25071658796897167, 4134),
        (286.9470092543453, 0.12510889327022737, 4878),
        (325.47179168073444, 0.146076715626144, 9072),
        (406.28608159380525, 0.1184840035765557, 13105),
        (542.8345877736307, 0.18304886584589053, 26186),
        (658.3438759717457, 0.1453141861419201, 17091),
        (748.8622925529071, 0.15035150048487841, 22874),
        (939.0524996455254, 0.10785123913152929, 78911),
        (1137.7385631886077, 0.11393908890280405, 60935),
        (1311.0135816283753, 0.11302331055425424, 67571),
        (1512.6337955497975, 0.12151686832371238, 71096),
        (1873.481154141868, 0.10769624554316103, 228303),
        (2294.5516322081285, 0.0884200408567425, 151775),
        (2650.257540312251, 0.07646629458863557, 162568),
        (3264.6405894267323, 0.061753255583145907, 466081),
        (3996.559275901764, 0.04985250374430074, 322725),
        (4963.0872300710125, 0.024390866250952794, 942282),
        (6089.1650977021745, 0.01719609384418311, 641605),
        (6977.417440220534, 0.012205073571614981, 843059),
        (8018.895376209841, 0.0037739824586502024, 1189138),
        (9855.980598923305, -0.008619905632704712, 2770379),
        (12133.985043609291, -0.011007969251297295, 1478364),
    ],
    "C": [
        (73.53977219682521, 0.07689749702241562, 734),
        (97.01735802135023, 0.040522758923728835, 883),
        (109.10957749334635, 0.1203309581618762, 1479),
        (222.52259771912924, 0.28475586848383677, 2462),
        (298.4052531409723, -0.05075206533412444, 1276),
        (322.4286468862194, 0.17428113386860578, 3717),
        (410.7644616180906, 0.26349082888085157, 10372),
        (556.454527500951, 0.1756581583195884, 16693),
        (656.5656853892211, 0.15289274842509226, 10555),
        (756.1459682743734, 0.15480607695780452, 17090),
        (936.1202881496173, 0.17711671955600097, 54832),
        (1140.8994126709229, 0.14235898530591953, 47662),
        (1305.7205599104834, 0.1292371550393766, 49403),
        (1513.9906273365816, 0.15697833469555283, 57408),
        (1860.9152588837999, 0.13107855340504998, 204280),
        (2302.6831508565233, 0.09576652059953059, 132776),
        (2644.0208407817936, 0.08155103441004911, 150005),
        (3265.028609746796, 0.06846606479297568, 385414),
        (3990.693212280379, 0.04740465272214198, 262552),
        (4973.992117280506, 0.026316608409477586, 752039),
        (6093.621278275981, 0.009000006922070631, 516714),
        (6974.487456676328, 0.01169298225009035, 681926),
        (8028.55133220673, 0.0033420293490986973, 982307),
        (9881.934566943715, -0.010335710352158065, 2349430),
        (12134.01356503164, -0.023196196830372873, 1243830),
    ],
}
# fixed values: published decay length, amplitude (where given) and R2
EXPECTED = {"A": (4548.59, 0.113802, 0.920486), "B": (3763.58, None, 0.965707), "C": (3329.78, None, 0.970146)}


@pytest.fixture(scope="module")
def bins(spark):
    rows = [(k, *r) for k, table in PUBLISHED.items() for r in table]
    return spark.createDataFrame(rows, "center string, distance_km double, mean_coherence double, n long").cache()


def test_published_exponential(bins):
    for row in fit.fit_decay(bins, ["center"], errors=True).collect():
        theta, amplitude, r2 = EXPECTED[row["center"]]
        assert row["theta"] == pytest.approx(theta, rel=1e-4)
        assert row["r2"] == pytest.approx(r2, abs=1e-5)
        assert not row["at_bound"]
        if amplitude:
            assert row["amplitude"] == pytest.approx(amplitude, rel=1e-3)
            assert row["aic"] == pytest.approx(118.87265806, abs=1e-4)
            assert row["se_theta"] == pytest.approx(863.87, rel=2e-3)
            assert row["se_amplitude"] == pytest.approx(0.0066916, rel=5e-3) and row["se_offset_c"] == pytest.approx(0.0064221, rel=5e-3)


def test_published_ranking(bins):
    best = {r["center"]: r for r in fit.fit_all(bins, ["center"]).where("rank = 1").collect()}
    assert best["B"]["model"] == "matern_1_5"
    assert best["B"]["delta_aic"] == 0


@pytest.mark.parametrize("name, theta", [("exponential", 2500.0), ("gaussian", 3000.0), ("squared_exponential", 1500.0), ("power_law", 0.7), ("matern_1_5", 900.0), ("matern_2_5", 1200.0)])
def test_recovers_parameters(spark, name, theta):
    m = fit.MODELS[name]
    df = spark.range(1, 26).selectExpr("1 AS grp", "id * 300D AS distance_km", "id + 10 AS n").withColumn("mean_coherence", 0.4 * F.expr(m.g("distance_km", repr(theta))) - 0.05)
    row = fit.fit_decay(df, ["grp"], name).first()
    assert row["theta"] == pytest.approx(theta, rel=1e-3)
    assert row["amplitude"] == pytest.approx(0.4, rel=1e-2)
    assert row["offset_c"] == pytest.approx(-0.05, abs=1e-3)


def test_box_and_small_groups(spark):
    rows = [(1, float(r), 0.1 + 0.001 * r, 5) for r in range(100, 900, 50)] + [(2, 100.0, 0.1, 1), (2, 200.0, 0.1, 1)]
    df = spark.createDataFrame(rows, "grp int, distance_km double, mean_coherence double, n int")
    out = {r["grp"]: r for r in fit.fit_decay(df, ["grp"]).collect()}
    assert 2 not in out
    assert out[1]["amplitude"] >= 1e-10
    assert -1 <= out[1]["offset_c"] <= 1


def test_harmonic_and_peak(spark):
    df = spark.range(0, 360, 5).selectExpr("1 AS grp", "radians(id) AS p", "0.3 * sin(radians(id) + 0.5) + 2 AS y")
    h = fit.fit_harmonic(df, ["grp"], "p", "y").first()
    assert (h["amplitude"], h["phase_shift"], h["level"], h["r2"]) == pytest.approx((0.3, 0.5, 2, 1), abs=1e-9)
    peak = spark.range(-40, 41).selectExpr("1 AS grp", "id AS x", "0.2 * exp(-pow((id - 4) / 5.0D, 2) / 2) + 0.1 AS y")
    p = fit.fit_peak(peak, ["grp"], "x", "y", list(range(-20, 21, 2)), [3, 5, 10]).first()
    assert (p["centre"], p["width"]) == (4, 5)
    assert p["amplitude"] == pytest.approx(0.2, abs=1e-6)
    assert p["significant"]


def test_wave(spark):
    df = spark.range(1, 60).selectExpr("1 AS grp", "id * 100D AS distance_km", "1 AS n", "0.5 * cos(2 * pi() * id * 100 / 3000) * exp(-id * 100 / 6000D) + 0.01 AS mean_coherence")
    w = fit.fit_wave(df, ["grp"]).first()
    assert w["wavelength"] == 3000
    assert w["r2"] == pytest.approx(1, abs=1e-9)


def test_published_errors(bins):
    """Standard errors of all three parameters, and their correlations against a direct inverse."""
    import numpy as np

    for row in fit.fit_decay(bins, ["center"], errors=True).collect():
        x, y, w = (np.array(v) for v in zip(*PUBLISHED[row["center"]], strict=True))
        g = np.exp(-x / row["theta"])
        slopes = np.stack([row["amplitude"] * x / row["theta"] ** 2 * g, g, np.ones_like(g)], axis=1)
        cov = np.linalg.inv(slopes.T @ (w[:, None] * slopes)) * row["wrss"] / (len(x) - 3)
        sd = np.sqrt(np.diag(cov))
        assert [row["se_theta"], row["se_amplitude"], row["se_offset_c"]] == pytest.approx(sd, rel=1e-4)
        got = [row["corr_theta_amplitude"], row["corr_theta_offset_c"], row["corr_amplitude_offset_c"]]
        assert got == pytest.approx([cov[0, 1] / sd[0] / sd[1], cov[0, 2] / sd[0] / sd[2], cov[1, 2] / sd[1] / sd[2]], abs=1e-4)


def test_key_names(spark):
    """Keys may bear the names that the fit uses inside, not those of its result."""
    rows = [(g, 100.0 * k, 0.2 * 2.718281828 ** (-100.0 * k / (900 + 300 * g)), 50) for g in range(2) for k in range(1, 30)]
    df = spark.createDataFrame(rows, "r int, distance_km double, mean_coherence double, n int").withColumns({"sw": F.col("r") + 5, "best": F.lit("b")})
    got = {x["r"]: x["theta"] for x in fit.fit_decay(df, ["r", "sw", "best"], errors=True).collect()}
    assert got == pytest.approx({0: 900, 1: 1200}, rel=1e-3)
    with pytest.raises(ValueError, match="r2"):
        fit.fit_decay(df.withColumn("r2", F.lit(1)), ["r2"])


@pytest.mark.parametrize(("alpha", "cut"), [(0.3, 3000.0), (0.15, 9000.0), (0.7, 1500.0)])
def test_planted_cutoff(spark, alpha, cut):
    """Exponent and cut-off of a planted curve are found together; a poorer choice of either leaves a larger residual."""
    rows = [(1, float(r), 2.0 * r**-alpha * 2.718281828459045 ** (-r / cut) - 0.01, 100 + r % 7) for r in range(80, 12_000, 350)]
    df = spark.createDataFrame(rows, "g int, distance_km double, mean_coherence double, n int")
    got = fit.fit_cutoff(df, ["g"]).first()
    assert got["alpha"] == pytest.approx(alpha, rel=0.01) and got["theta"] == pytest.approx(cut, rel=0.02)
    assert got["amplitude"] == pytest.approx(2.0, rel=0.03) and got["offset_c"] == pytest.approx(-0.01, abs=1e-3) and got["r2"] > 0.999999
    assert {r["g"] for r in fit.fit_cutoff(df.unionByName(df.limit(4).withColumn("g", F.lit(2))), ["g"]).collect()} == {1}


def test_single_rows_are_folded(spark):
    """A fit on single rows equals that of the same rows as bins of one; its grid is read by distances, not by rows."""
    rng = random.Random(3)
    rows = [(g, d, math.exp(-d / 2000) + rng.gauss(0, 0.1), 1.0 + k % 2) for g in "ab" for k in range(300) for d in (100.0, 800.0, 2500.0, 4000.0, 9000.0)] + [("c", 1.0, 1.0, 1.0), ("a", None, 1.0, 1.0), ("a", 5.0, None, 1.0), ("a", 5.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, distance_km double, mean_coherence double, n double")
    kept = fit.cut
    folded = []
    try:
        fit.cut = lambda x: (folded.append(kept(x)), folded[-1])[1]
        single = {r["g"]: r for r in fit.fit_decay(df, ["g"], ["exponential", "gaussian"], errors=True, together=False).where("model = 'exponential'").collect()}
    finally:
        fit.cut = kept
    assert folded[0].count() == 11
    bins = {r["g"]: r for r in fit.fit_decay(df, ["g"], errors=True).collect()}
    assert set(single) == set(bins) == {"a", "b"} and bins["a"]["n_bins"] == single["a"]["n_bins"] == 1500
    for g in "ab":
        assert all(abs(single[g][c] - bins[g][c]) < 1e-6 * max(1, abs(bins[g][c])) for c in ("theta", "amplitude", "offset_c", "wrss", "r2", "se_theta"))
