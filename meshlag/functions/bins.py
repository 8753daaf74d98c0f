"""Logarithmic distance bins with exact edges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlag.config import DEFAULT, Config


def edges(config: Config = DEFAULT) -> list[float]:
    lo, hi = math.log10(config.least_km), math.log10(config.most_km)
    return [10 ** (lo + (hi - lo) * k / config.bins) for k in range(config.bins + 1)]


def bin_text(distance: str, config: Config = DEFAULT) -> str:
    return f"cast(floor({config.bins} * ln(({distance}) / {config.least_km}) / ln({config.most_km / config.least_km!r})) AS int)"


def distance_bin(distance: str, config: Config = DEFAULT, closed: str = "left") -> Column:
    """Bin index 0..bins-1, null outside. The logarithm proposes a bin; the literal edges decide."""
    e = F.array(*[F.lit(x) for x in edges(config)])
    d = F.col(distance)
    k = F.least(F.greatest(F.expr(bin_text(f"greatest({distance}, {config.least_km / 2})", config)), F.lit(0)), F.lit(config.bins - 1))
    low, high = F.element_at(e, k + 1), F.element_at(e, k + 2)
    if closed == "left":
        moved = F.when(d < low, k - 1).when(d >= high, k + 1).otherwise(k)
    else:
        moved = F.when(d <= low, k - 1).when(d > high, k + 1).otherwise(k)
    return F.when(moved.between(0, config.bins - 1), moved).cast("int")


def accumulate(pairs: DataFrame, keys: list[str], value: str = "coherence", distance: str = "dist_km", bin_col: str = "bin") -> DataFrame:
    """Mergeable state of a bin: sums of the value, its square and the distance, and the count."""
    return pairs.groupBy(*keys, bin_col).agg(F.sum(value).alias("s1"), F.sum(F.col(value) * F.col(value)).alias("s2"), F.sum(distance).alias("sd"), F.count("*").alias("n"))


def finalise(state: DataFrame, min_count: int = DEFAULT.min_bin_count) -> DataFrame:
    """Means and population deviation of bins with enough rows."""
    return state.where(F.col("n") >= min_count).withColumns({
        "mean_coherence": F.col("s1") / F.col("n"), "distance_km": F.col("sd") / F.col("n"),
        "std_coherence": F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - F.pow(F.col("s1") / F.col("n"), 2))),
    })
