"""All lags, demodulated phases and event-locked spreads against direct computation on small series."""

import math

import numpy as np
import pytest

from meshlag.operators import lags


@pytest.mark.parametrize("block", [4, 16, 64])
def test_all_lags(spark, block):
    rng = np.random.default_rng(block)
    rows = [(s, int(t), float(rng.normal())) for s in "xyz" for t in range(-20, 90) if rng.random() < 0.8] + [("x", 300, 2.0), ("y", 5000, None)]
    values = {}
    for s, t, v in rows:
        if v is not None:
            values.setdefault(s, {})[t] = v
    want = {}
    for a in "xyz":
        for b in "xyz":
            if a < b:
                for t, v in values[a].items():
                    for u, x in values[b].items():
                        have = want.setdefault((a, b, u - t), [0.0, 0])
                        have[0] += v * x
                        have[1] += 1
    got = {(r["a"], r["b"], r["lag"]): (r["total"], r["n"]) for r in lags.all_lags(spark.createDataFrame(rows, "s string, t int, v double"), "s", "t", "v", block).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][1] == n and got[k][0] == pytest.approx(x, abs=1e-8) for k, (x, n) in want.items())


def test_demodulation(spark):
    """A wave of a nearby period turns steadily, which gives its period back; gaps don't bend it."""
    rows = [(k, t, math.cos(2 * math.pi * t / p) + 0.3) for k, p in (("a", 30.0), ("b", 26.0)) for t in range(600) if t % 11]
    df = spark.createDataFrame(rows, "k string, t int, y double")
    waves = lags.momentary_period(lags.demodulate(df, ["k"], "t", "y", {"28d": 28.0}, 1.5), ["k"], "t")
    for k, p in (("a", 30.0), ("b", 26.0)):
        inner = [r for r in waves.where(f"k = '{k}'").collect() if 130 < r["t"] < 470]
        assert len(inner) > 300 and all(abs(r["momentary"] - p) < 0.15 and 0.3 < r["amplitude"] < 0.52 for r in inner)
    ends = [r for r in waves.collect() if r["turn"] is None]
    assert len(ends) == 4  # both ends of both series
    one = waves.where("k = 'a' AND t = 300").first()
    near = [(t, y) for k, t, y in rows if k == "a" and abs(t - 300) <= math.ceil(3 * 1.5 * 28)]
    g = np.array([math.exp(-0.5 * ((t - 300) / 42) ** 2) for t, _ in near])
    z = sum(w * y * np.exp(-2j * np.pi * t / 28) for w, (t, y) in zip(g, near, strict=True)) / g.sum()
    assert (one["re"], one["im"]) == pytest.approx((z.real, z.imag), abs=1e-9)


def brute_locked(values, events, shifts, inside, beside, least):
    n, out = len(values), []
    for s in range(shifts + 1):
        effects = []
        for e in events:
            at = (e + s * lags.PRIME_STEP) % n
            near = [values[k] for k in range(max(0, at - inside), min(n, at + inside + 1)) if values[k] is not None]
            far = [values[k] for k in [*range(max(0, at - inside - beside), max(0, at - inside)), *range(min(n, at + inside + 1), min(n, at + inside + beside + 1))] if values[k] is not None]
            if len(near) >= least[0] and len(far) >= least[1]:
                effects.append(np.std(near) - np.std(far))
        out.append(np.mean(effects) if effects else None)
        count = len(effects) if s == 0 else count
    known = [x for x in out[1:] if x is not None]
    return count, out[0], (sum(x >= out[0] - 1e-9 for x in known) + 1) / (len(known) + 1)


def test_event_locked(spark):
    """The wide spread planted around events is found; a quiet series and events at the very ends are as by hand."""
    rng = np.random.default_rng(9)
    events = [0, 60, 150, 240, 299]
    series = {"wild": [float(rng.normal(28, 3 if min(abs(k - e) for e in events) <= 5 else 0.3)) for k in range(300)], "calm": [None if k % 4 == 0 else float(rng.normal(28, 1)) for k in range(300)]}
    df = spark.createDataFrame([(s, 10 + 2 * k, v) for s, x in series.items() for k, v in enumerate(x)], "s string, t int, v double")
    asked = spark.createDataFrame([(s, 10 + 2 * e) for s in series for e in events] + [("wild", 11)], "s string, t int")
    got = {r["s"]: r for r in lags.event_locked(df, ["s"], "t", "v", asked, 40, inside=5, beside=20, least=(4, 10)).collect()}
    for s, x in series.items():
        count, effect, p = brute_locked(x, events, 40, 5, 20, (4, 10))
        assert (got[s]["events"], got[s]["effect"], got[s]["p_value"]) == (count, pytest.approx(effect, abs=1e-7), pytest.approx(p))
    assert got["wild"]["p_value"] < 0.1 < got["calm"]["p_value"] and got["wild"]["effect"] > 1
