"""Inference on result tables: corrections for many tests, correlation p-values, circular statistics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlag.functions.cut import cut


def correct(tests: DataFrame, p: str = "p_value", family: str = "family", name: str = "name") -> DataFrame:
    """Adds bonferroni, bh and family_bonferroni adjusted p-values. Missing p-values stay missing and don't count.

    A registry holds one row a test, some hundreds or thousands, so its running minimum is taken in one task.
    """
    known = tests.where(F.col(p).isNotNull())
    everything = Window.partitionBy(F.lit(1))
    order = Window.partitionBy(F.lit(1)).orderBy(p, family, name)
    down = Window.partitionBy(F.lit(1)).orderBy(F.desc("rank_")).rowsBetween(Window.unboundedPreceding, 0)
    out = known.withColumns({"m_": F.count("*").over(everything), "rank_": F.row_number().over(order), "f_": F.count("*").over(Window.partitionBy(family))})
    out = out.withColumn("bh", F.least(F.lit(1.0), F.min(F.col(p) * F.col("m_") / F.col("rank_")).over(down)))
    return out.withColumns({"bonferroni": F.least(F.lit(1.0), F.col(p) * F.col("m_")), "family_bonferroni": F.least(F.lit(1.0), F.col(p) * F.col("f_"))}).drop("m_", "rank_", "f_")


def significant_by_family(tests: DataFrame, level: float = 0.05, p: str = "p_value", family: str = "family", name: str = "name") -> DataFrame:
    """(family, tests, raw, bonferroni, in_family, bh, least_p): how many tests of each family stay below the level under each correction.

    For registries of any size: the step-up method needs no adjusted values, only the last rank k whose p lies below
    level * k / tests, and ranks are taken over ranges. Missing p-values don't count.
    """
    from meshlag.operators.resample import shuffled_rank

    known = tests.where(F.col(p).isNotNull()).select(F.col(family).alias("family"), F.col(name).alias("name"), F.col(p).cast("double").alias("p"))
    ranked = cut(shuffled_rank(known, ["p", "family", "name"], "k"))
    m = ranked.count()
    last = ranked.where(F.col("p") * m / F.col("k") < level).agg(F.max("k")).first()[0] or 0
    sizes = ranked.groupBy("family").agg(F.count("*").alias("f"))  # families are few
    below = lambda c: F.sum(c.cast("long"))
    return ranked.join(F.broadcast(sizes), "family").groupBy(F.col("family").alias(family)).agg(
        F.count("*").alias("tests"), below(F.col("p") < level).alias("raw"), below(F.col("p") * m < level).alias("bonferroni"), below(F.col("p") * F.col("f") < level).alias("in_family"), below(F.col("k") <= last).alias("bh"), F.min("p").alias("least_p")
    )


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_p_value(t: float | None, df: float | None) -> float | None:
    """Two-sided p of a t statistic."""
    if t is None or df is None or t != t or df <= 0:
        return None
    return beta_tail(df / 2, 0.5, df / (df + t * t))


def _p_of_r(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or x != x or k < 3 else 0.0 if abs(x) >= 1 else t_p_value(x * math.sqrt((k - 2) / (1 - x * x)), k - 2) for x, k in zip(r, n, strict=True)], dtype=float)


def _p_of_t(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_p_value(x, k) for x, k in zip(t, df, strict=True)], dtype=float)


def _p_of_f(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or x != x or a <= 0 or b <= 0 else beta_tail(b / 2, a / 2, b / (b + a * max(x, 0.0))) for x, a, b in zip(f, d1, d2, strict=True)], dtype=float)


def p_of_r(r: Column, n: Column) -> Column:
    """Two-sided p of Pearson's r with n - 2 degrees of freedom; for aggregated rows only."""
    return F.pandas_udf(_p_of_r, "double")(r, n)


def p_of_t(t: Column, df: Column) -> Column:
    """Two-sided p of a t statistic."""
    return F.pandas_udf(_p_of_t, "double")(t, df)


def p_of_f(f: Column, d1: Column, d2: Column) -> Column:
    """Upper tail of the F distribution."""
    return F.pandas_udf(_p_of_f, "double")(f, d1, d2)


def rayleigh_p(r: Column, n: Column) -> Column:
    """p of uniformity for a mean resultant length r of n angles."""
    big = n * r
    return F.exp(F.sqrt(1 + 4 * n + 4 * (n * n - big * big)) - (1 + 2 * n))


def average_rank(df: DataFrame, value: str, name: str, keys: list[str]) -> DataFrame:
    """Rank with ties averaged, inside each group."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    return df.withColumn(name, F.rank().over(w.orderBy(value)) + (F.count("*").over(w.partitionBy(*keys, value) if keys else Window.partitionBy(value)) - 1) / 2)


def weighted_percentile(df: DataFrame, keys: list[str], value: str, weight: str, q: float | list[float]) -> DataFrame:
    """(keys, percentile): least value at which the cumulated weight reaches q of the total; with a list, (keys, q, percentile).

    Weights are summed by value first; the distinct values are dealt by range, and a value's cumulated weight is
    that inside its range plus the sums of the ranges before it: no task holds a whole group.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value_")).agg(F.sum(weight).alias("w_"))
    dealt = cut(sums.repartitionByRange(n, *keys, "value_").withColumn("p_", F.spark_partition_id()))
    ranges = dealt.groupBy(*keys, "p_").agg(F.sum("w_").alias("r_"))
    w = Window.partitionBy(*keys)
    before = ranges.select(*keys, "p_", (F.sum("r_").over(w.orderBy("p_")) - F.col("r_")).alias("before_"), F.sum("r_").over(w).alias("all_"))
    reached = dealt.join(before, [*keys, "p_"]).withColumn("cum_", F.col("before_") + F.sum("w_").over(Window.partitionBy(*keys, "p_").orderBy("value_")))
    if isinstance(q, list):
        reached = reached.withColumn("q", F.explode(F.array(*[F.lit(float(x)) for x in q])))
        return reached.where(F.col("cum_") >= F.col("q") * F.col("all_")).groupBy(*keys, "q").agg(F.min("value_").alias("percentile"))
    return reached.where(F.col("cum_") >= q * F.col("all_")).groupBy(*keys).agg(F.min("value_").alias("percentile"))
