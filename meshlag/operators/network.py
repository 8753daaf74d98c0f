"""Graphs of pairs and series of networks: degrees, triangles, clustering, autocorrelation, steady cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlag.functions import geo
from meshlag.functions.cut import cut


def clustering(edges: DataFrame, keys: list[str], a: str = "i", b: str = "j") -> DataFrame:
    """(keys, node, degree, triangles, clustering) of undirected simple graphs, one graph for each value of `keys`.

    Each edge points from the end of lower degree to the other (ties to the smaller name), so no node has more
    than about sqrt(2 * edges) edges that leave it, however many meet it: a hub makes no crowd of open triangles.
    Two edges that leave one node form a triangle if their far ends are joined; it is found once and counts for its
    three nodes. Clustering is the share of a node's pairs of neighbours that are joined; null below two neighbours.
    Repeated edges, loops and edges with a null end count once, not at all and not at all.
    """
    plain = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    plain = cut(plain.select(*keys, F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b")).distinct())
    degree = cut(plain.withColumn("node", F.explode(F.array("_a", "_b"))).groupBy(*keys, "node").agg(F.count("*").alias("degree")))
    ranked = plain
    for end in ("_a", "_b"):
        ranked = ranked.join(degree.select(*keys, F.col("node").alias(end), F.struct("degree", "node").alias(f"{end}_rank")), [*keys, end])
    low, high = F.least("_a_rank", "_b_rank"), F.greatest("_a_rank", "_b_rank")
    out = cut(ranked.select(*keys, low.alias("low"), high.alias("high")))
    open_ = out.join(out.select(*keys, "low", F.col("high").alias("far")), [*keys, "low"]).where("high < far")
    closed = open_.join(out.select(*keys, F.col("low").alias("high"), F.col("high").alias("far")), [*keys, "high", "far"])
    corners = closed.withColumn("node", F.explode(F.array("low.node", "high.node", "far.node"))).groupBy(*keys, "node").agg(F.count("*").alias("triangles"))
    joined = degree.join(corners, [*keys, "node"], "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    return joined.withColumn("clustering", F.expr("CASE WHEN degree > 1 THEN 2 * triangles / (cast(degree AS double) * (degree - 1)) END"))


def clustering_sql(edges: str, key: str, a: str = "i", b: str = "j") -> str:
    plain = f"(SELECT DISTINCT {key}, {a} AS i, {b} AS j FROM {edges} e0)"
    corner = f"(SELECT x.{key}, unnest([x.i, x.j, y.j]) AS node FROM {plain} x JOIN {plain} y ON x.{key} = y.{key} AND x.j = y.i JOIN {plain} z ON z.{key} = x.{key} AND z.i = x.i AND z.j = y.j)"
    degree = f"(SELECT {key}, node, count(*) AS degree FROM (SELECT {key}, unnest([i, j]) AS node FROM {plain} q) u GROUP BY 1, 2)"
    return f"(SELECT d.{key}, d.node, degree, coalesce(c.triangles, 0) AS triangles, CASE WHEN degree > 1 THEN 2 * coalesce(c.triangles, 0) / (degree * (degree - 1)::double) END AS clustering FROM {degree} d LEFT JOIN (SELECT {key}, node, count(*) AS triangles FROM {corner} k GROUP BY 1, 2) c ON c.{key} = d.{key} AND c.node = d.node)"


def autocorrelation(df: DataFrame, keys: list[str], t: str, y: str, lags: int) -> DataFrame:
    """(keys, lag, r, n): correlation of a series with itself `lag` steps of the integer `t` later, 0 < lag <= lags.

    Values less the group's mean are multiplied by equality of step and lag, so gaps in `t` stay gaps, and sums of
    products over the sum of squares are what r is. Sums come together by (keys, lag). Null values drop out; a
    constant series has null r.
    """
    kept = df.where(F.col(t).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(t).alias("_t"), F.col(y).alias("_y"))
    mean = kept.groupBy(*keys).agg(F.avg("_y").alias("_m"), F.var_pop("_y").alias("_v"), F.count("*").alias("_n"))
    level = kept.join(mean, keys).withColumn("_z", F.col("_y") - F.col("_m"))
    early = level.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(lags)))).withColumn("_t", F.col("_t") + F.col("lag"))
    late = level.select(*keys, "_t", F.col("_z").alias("_l"))
    sums = early.join(late, [*keys, "_t"]).groupBy(*keys, "lag").agg(F.sum(F.col("_z") * F.col("_l")).alias("s"), F.count("*").alias("n"), F.max("_v").alias("v"), F.max("_n").alias("all"))
    return sums.select(*keys, "lag", F.expr("CASE WHEN v > 0 THEN s / (v * all) END").alias("r"), "n")


def autocorrelation_sql(rows: str, key: str, t: str, y: str, lags: int) -> str:
    level = f"(SELECT {key}, {t} AS t, {y} - avg({y}) OVER w AS z, var_pop({y}) OVER w AS v, count(*) OVER w AS n FROM {rows} s WHERE {y} IS NOT NULL WINDOW w AS (PARTITION BY {key}))"
    return f"(SELECT x.{key}, y.t - x.t AS lag, CASE WHEN max(x.v) > 0 THEN sum(x.z * y.z) / (max(x.v) * max(x.n)) END AS r, count(*) AS n FROM {level} x JOIN {level} y ON x.{key} = y.{key} AND y.t - x.t BETWEEN 1 AND {lags} GROUP BY 1, 2)"


#: Deviation below which a series or a cycle counts as constant.
FLAT, FLAT_CYCLE = 1e-8, 1e-12


def _of(phase: str, flat: str) -> dict[str, str]:
    still = lambda wave: f"stddev_pop(y) < {FLAT!r} OR stddev_pop({wave}({phase})) < {flat}"
    return {f"r_{wave}": f"CASE WHEN count(y) < 3 OR {still(wave)} THEN NULL ELSE covar_pop(y, {wave}({phase})) / (stddev_pop(y) * stddev_pop({wave}({phase}))) END" for wave in ("sin", "cos")}


_stronger = {"r": "CASE WHEN r_cos IS NULL OR abs(r_sin) > abs(r_cos) THEN r_sin ELSE r_cos END", "component": "CASE WHEN r_sin IS NULL AND r_cos IS NULL THEN NULL WHEN r_cos IS NULL OR abs(r_sin) > abs(r_cos) THEN 'sine' ELSE 'cosine' END"}


def cycles(df: DataFrame, keys: list[str], day: str, y: str, periods: tuple[float, ...]) -> DataFrame:
    """(keys, period, n, r, component): the stronger correlation of `y` with the sine or cosine of each cycle of days.

    A cycle that all days meet at one phase, such as a day itself, and a constant series have null r. Sums are
    taken for all periods in one aggregation.
    """
    rows = df.select(*keys, F.col(day).alias("_d"), F.col(y).alias("y")).where("y IS NOT NULL")
    sums = []
    for period in periods:
        phase = geo.cycle_phase("_d", period)
        sums.append(F.struct(F.lit(period).alias("period"), *[F.expr(v).alias(k) for k, v in _of(phase, repr(FLAT_CYCLE)).items()]))
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*sums).alias("c")).select(*keys, "n", F.inline("c"))
    return found.select(*keys, "period", "n", *[F.expr(v).alias(k) for k, v in _stronger.items()])


def cycles_sql(rows: str, key: str, day: str, y: str, periods: tuple[float, ...]) -> str:
    one = lambda p: f"SELECT {key}, {p!r}::double AS period, count(*) AS n, {', '.join(f'{v} AS {k}' for k, v in _of(geo.cycle_phase('d', p), repr(FLAT_CYCLE)).items())} FROM (SELECT {key}, {day} AS d, {y} AS y FROM {rows} s) q WHERE y IS NOT NULL GROUP BY {key}"
    return f"(SELECT {key}, period, n, {', '.join(f'{v} AS {k}' for k, v in _stronger.items())} FROM ({' UNION ALL '.join(one(p) for p in periods)}) u)"


def p_of_r_sql(r: str, n: str) -> str:
    """Two-sided p of Pearson's r as SQL for a twin: with whole degrees of freedom the t distribution is a finite sum.

    With v = n - 2, the chance of a smaller |t| is |r| times the sum of c(k) * (1 - r*r)^k, c from gamma functions,
    for even v; for odd v it is 2/pi times (asin|r| + |r| times the like sum with a further root).
    """
    even = f"abs({r}) * list_sum(list_transform(range(0, greatest(1, ({n} - 2) // 2)), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1) - lgamma(0.5) + k * ln(1 - {r} * {r}))))"
    odd = f"2 / pi() * (asin(abs({r})) + CASE WHEN {n} > 3 THEN abs({r}) * list_sum(list_transform(range(0, greatest(1, ({n} - 3) // 2)), lambda k: exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5) + (k + 0.5) * ln(1 - {r} * {r})))) ELSE 0 END)"
    return f"CASE WHEN {r} IS NULL OR {n} < 3 THEN NULL WHEN abs({r}) >= 1 THEN 0.0 WHEN {n} % 2 = 0 THEN greatest(0.0, 1 - {even}) ELSE greatest(0.0, 1 - {odd}) END"
