"""Lags over whole series and phases over time: block transforms, complex demodulation, and tests by shifted events."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlag.functions.cut import cut

PRIME_STEP = 7919


def all_lags(df: DataFrame, series: str, t: str, y: str, block: int = 256) -> DataFrame:
    """(a, b, lag, total, n): for series a < b and every lag, the sum of y_a(t) y_b(t + lag) and how many products it has.

    `t` is an integer; gaps are left out of sums and counts. A series is cut into blocks of `block` steps, each of
    which is transformed once, padded to twice its length, beside the transform of its presence. Products of the
    spectra of a block of a and a block of b belong to the lags around the distance of the blocks, so they are
    added up by that distance before one transform back: work grows with blocks squared, not rows squared, and
    no task holds more than the spectra of a block.
    """
    width, half = 2 * block, block + 1

    @F.arrow_udf("array<double>")
    def transformed(values: pa.Array) -> pa.Array:
        rows = np.asarray(values.flatten()).reshape(-1, block)
        spectrum = np.fft.rfft(rows, width, axis=1)
        return pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([spectrum.real, spectrum.imag], axis=1).ravel()), 2 * half).cast(pa.list_(pa.float64()))

    @F.arrow_udf("array<double>")
    def restored(values: pa.Array) -> pa.Array:
        rows = np.asarray(values.flatten()).reshape(-1, 2 * half)
        back = np.roll(np.fft.irfft(rows[:, :half] + 1j * rows[:, half:], width, axis=1), block, axis=1)  # lags -block .. block - 1
        return pa.FixedSizeListArray.from_arrays(pa.array(back.ravel()), width).cast(pa.list_(pa.float64()))

    placed = df.where(F.col(y).isNotNull()).select(F.col(series).alias("s"), F.floor(F.col(t) / block).alias("k"), F.pmod(F.col(t), F.lit(block)).cast("int").alias("at"), F.col(y).cast("double").alias("v"))
    rows = placed.groupBy("s", "k").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"))  # at most `block` entries
    steps = F.sequence(F.lit(0), F.lit(block - 1))
    value = F.transform(steps, lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    present = F.transform(steps, lambda i: F.element_at("m", i).isNotNull().cast("double"))
    both = rows.select("s", "k", F.explode(F.array(F.struct(F.lit(0).alias("kind"), value.alias("x")), F.struct(F.lit(1).alias("kind"), present.alias("x")))).alias("e"))
    spectra = cut(both.select("s", "k", "e.kind", transformed("e.x").alias("z")))
    lines = spectra.select("s", "k", "kind", F.posexplode(F.slice("z", 1, half)).alias("f", "re"), "z").select("s", "k", "kind", "f", "re", F.get("z", F.col("f") + half).alias("im"))
    a, b = (lines.select(F.col("s").alias(e), F.col("k").alias(f"k_{e}"), "kind", "f", F.col("re").alias(f"re_{e}"), F.col("im").alias(f"im_{e}")) for e in "ab")
    met = a.join(b, ["kind", "f"]).where("a < b").withColumn("d", F.col("k_b") - F.col("k_a"))
    summed = met.groupBy("a", "b", "kind", "d", "f").agg(F.sum(F.expr("re_a * re_b + im_a * im_b")).alias("re"), F.sum(F.expr("re_a * im_b - im_a * re_b")).alias("im"))
    whole = summed.groupBy("a", "b", "kind", "d").agg(F.array_sort(F.collect_list(F.struct("f", "re", "im"))).alias("q"))  # block + 1 lines
    back = whole.select("a", "b", "kind", "d", restored(F.concat(F.transform("q", lambda x: x["re"]), F.transform("q", lambda x: x["im"]))).alias("c"))
    lags = back.select("a", "b", "kind", (F.col("d") * block).alias("from"), F.posexplode("c").alias("p", "v")).groupBy("a", "b", (F.col("from") + F.col("p") - block).alias("lag")).agg(
        F.sum(F.when(F.col("kind") == 0, F.col("v"))).alias("total"), F.round(F.sum(F.when(F.col("kind") == 1, F.col("v")))).cast("long").alias("n")
    )
    return lags.where("n > 0")


def demodulate(df: DataFrame, keys: list[str], t: str, y: str, periods: dict[str, float], widths: float = 1.0) -> DataFrame:
    """(keys, period, t, re, im): the series times a wave of each period, averaged under a Gaussian of `widths` periods around each day.

    The filter reaches three deviations to either side and is divided by its weights there, so gaps and ends count
    as they are. A row is sent to the days it reaches and the sums are combined where it lies: a series need not
    lie in one task. `re` and `im` turn with the phase against a steady wave of the period.
    """
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("period"), F.lit(float(p)).alias("p"), F.lit(math.ceil(3 * widths * p)).alias("reach")) for n, p in periods.items()])).alias("w")
    days = df.select(*keys, F.col(t).alias("_t"), F.col(y).alias("_y"), named).select(*keys, "_t", "_y", "w.*")
    sent = days.withColumn("_o", F.explode(F.expr("sequence(-reach, reach)"))).withColumn("_g", F.exp(-0.5 * (F.col("_o") / (widths * F.col("p"))) ** 2))
    angle = 2 * np.pi * F.col("_t") / F.col("p")
    sums = sent.groupBy(*keys, "period", "p", (F.col("_t") + F.col("_o")).alias(t)).agg(F.sum("_g").alias("g"), F.sum(F.col("_g") * F.col("_y") * F.cos(angle)).alias("c"), F.sum(F.col("_g") * F.col("_y") * F.sin(angle)).alias("s"))
    own = df.select(*keys, t).distinct()
    return sums.join(own, [*keys, t]).select(*keys, "period", "p", t, (F.col("c") / F.col("g")).alias("re"), (-F.col("s") / F.col("g")).alias("im"))


def momentary_period(waves: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Adds amplitude, turn (change of the phase a day, across the neighbouring rows) and momentary, the period that it makes; null at ends, at a standstill and backwards."""
    w = Window.partitionBy(*keys, "period").orderBy(t)
    before, after = {c: F.lag(c).over(w) for c in ("re", "im", t)}, {c: F.lead(c).over(w) for c in ("re", "im", t)}
    across = F.atan2(after["im"] * before["re"] - after["re"] * before["im"], after["re"] * before["re"] + after["im"] * before["im"]) / (after[t] - before[t])
    rate = 1 / F.col("p") + F.col("turn") / (2 * np.pi)
    return waves.withColumns({"amplitude": F.sqrt(F.col("re") ** 2 + F.col("im") ** 2), "turn": across}).withColumn("momentary", F.when(rate > 1 / (10 * F.col("p")), 1 / rate))


def gated(df: DataFrame, keys: list[str], level: str, value: str, percentile: float) -> DataFrame:
    """`value` where `level` reaches its percentile in the group, else null."""
    least = df.groupBy(*keys).agg(F.percentile(level, percentile).alias("_least"))
    return df.join(F.broadcast(least), keys).withColumn(value, F.when(F.col(level) >= F.col("_least"), F.col(value))).drop("_least")  # a few groups


def event_locked(df: DataFrame, keys: list[str], order: str, value: str, events: DataFrame, shifts: int, inside: int = 15, beside: int = 60, least: tuple[int, int] = (5, 20)) -> DataFrame:
    """(keys, events, effect, p_value): how much more a value spreads near events than beside them, against shifted events.

    The spread within `inside` rows of an event less that within `beside` rows on both sides, where enough values are
    known; the mean over events; p is the share of circular shifts of all events (multiples of a prime number of
    rows) whose effect is as large, with the real one counted. `events` holds keys and `order`. Counts and sums run
    along the series once; a shifted event then reads them at four places by equality.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    mean = F.avg(value).over(Window.partitionBy(*keys))  # sums around the mean keep their digits
    placed = df.withColumn("_v", F.col(value) - mean).withColumns({"_k": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy(*keys)), "_c": F.count("_v").over(run), "_s": F.coalesce(F.sum("_v").over(run), F.lit(0.0)), "_q": F.coalesce(F.sum(F.col("_v") ** 2).over(run), F.lit(0.0))})
    placed = cut(placed.select(*keys, order, "_k", "_n", "_c", "_s", "_q"))
    asked = placed.join(events.select(*keys, order).distinct(), [*keys, order]).withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(shifts))))
    asked = asked.select(*keys, "shift", F.col("_k").alias("event"), "_n", (F.pmod(F.col("_k") - 1 + F.col("shift") * PRIME_STEP, F.col("_n")) + 1).alias("at"))
    edges = {"a": F.greatest(F.lit(0), F.col("at") - inside - beside - 1), "b": F.greatest(F.lit(0), F.col("at") - inside - 1), "c": F.least(F.col("_n"), F.col("at") + inside), "d": F.least(F.col("_n"), F.col("at") + inside + beside)}
    bounds = asked.select(*keys, "shift", "event", F.explode(F.array(*[F.struct(F.lit(e).alias("edge"), v.cast("int").alias("_k")) for e, v in edges.items()])).alias("x")).select(*keys, "shift", "event", "x.*")
    read = bounds.join(placed.select(*keys, "_k", "_c", "_s", "_q"), [*keys, "_k"], "left")
    sums = read.groupBy(*keys, "shift", "event").agg(*[F.coalesce(F.max(F.when(F.col("edge") == e, F.col(f"_{c}"))), F.lit(0)).alias(f"{c}_{e}") for e in edges for c in "csq"])
    part = lambda c: {"in": f"({c}_c - {c}_b)", "out": f"({c}_d - {c}_c + {c}_b - {c}_a)"}
    spread = lambda k: f"sqrt(greatest(0.0D, {part('q')[k]} / {part('c')[k]} - pow({part('s')[k]} / {part('c')[k]}, 2)))"
    effect = F.expr(f"CASE WHEN {part('c')['in']} >= {least[0]} AND {part('c')['out']} >= {least[1]} THEN {spread('in')} - {spread('out')} END")
    each = sums.withColumn("e", effect).groupBy(*keys, "shift").agg(F.count("e").alias("events"), F.avg("e").alias("effect"))
    real = each.where("shift = 0").select(*keys, "events", F.col("effect").alias("real"))
    out = each.where("shift > 0").select(*keys, "effect").join(real, keys).groupBy(*keys, "events", "real").agg(F.count("effect").alias("k"), F.sum((F.col("effect") >= F.col("real") - 1e-9).cast("int")).alias("above"))
    return out.select(*keys, "events", F.col("real").alias("effect"), ((F.coalesce("above", F.lit(0)) + 1) / (F.col("k") + 1)).alias("p_value"))
