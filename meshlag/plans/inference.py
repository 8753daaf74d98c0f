"""Corrections for many tests, result documents, lookups by name: F1-F9, P11-P15, R17-R20, S14, K1-K7, C30-C33."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlag.operators import fit
from meshlag.operators.stats import correct, p_of_f, p_of_r, p_of_t, significant_by_family
from meshlag.plans.decay import ERRORS, bins, bins_sql
from meshlag.plans.fixtures import EXTERNAL_SQL, PAIR_DAY_SQL, daily, external_daily, pair_day, read
from meshlag.plans.registry import query, r, select
from meshlag.sources.tables import as_columns, collected_tests, p_values, resolve_codes, validate_activity

_tests = f"(SELECT center AS family, 's' || i AS name, round(least(1.0, abs(avg(coherence)) * 5 + i * 0.001), 9) AS p_value FROM {PAIR_DAY_SQL} p GROUP BY center, i)"


def test_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of (family, name, p_value): one entry for each centre and station."""
    p = pair_day(spark, sf_dir, False)
    return p.groupBy("center", "i").agg(F.round(F.expr("least(1.0D, abs(avg(coherence)) * 5 + i * 0.001D)"), 9).alias("p_value")).select(F.col("center").alias("family"), F.concat(F.lit("s"), F.col("i")).alias("name"), "p_value")


_corrected = f"""(SELECT family, name, p_value, least(1.0, p_value * m) AS bonferroni, least(1.0, p_value * f) AS family_bonferroni, least(1.0, min(p_value * m / k) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS bh
    FROM (SELECT *, count(*) OVER () AS m, count(*) OVER (PARTITION BY family) AS f, row_number() OVER (ORDER BY p_value, family, name) AS k FROM {_tests} t) q)"""


@query(f"SELECT family, name, {r('p_value')} AS p_value, {r('bonferroni')} AS bonferroni, {r('family_bonferroni')} AS family_bonferroni, {r('bh')} AS bh FROM {_corrected} c")
def corrected_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = correct(test_registry(spark, sf_dir))
    return select(c, {"family": "family", "name": "name", **{k: r(k) for k in ("p_value", "bonferroni", "family_bonferroni", "bh")}})


@query(f"SELECT method, cast(sum(CASE WHEN p < 0.05 THEN 1 ELSE 0 END) AS bigint) AS significant, count(*) AS tests FROM (SELECT 'raw' AS method, p_value AS p FROM {_corrected} a UNION ALL SELECT 'bonferroni', bonferroni FROM {_corrected} b UNION ALL SELECT 'family', family_bonferroni FROM {_corrected} c UNION ALL SELECT 'bh', bh FROM {_corrected} d) u GROUP BY method")
def correction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = correct(test_registry(spark, sf_dir))
    long = c.select(F.expr("stack(4, 'raw', p_value, 'bonferroni', bonferroni, 'family', family_bonferroni, 'bh', bh) AS (method, p)"))
    return long.groupBy("method").agg(F.sum(F.when(F.col("p") < 0.05, 1).otherwise(0)).alias("significant"), F.count("*").alias("tests"))


@query()
def inference_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p of r, t and F for each centre's relation of coherence and distance."""
    g = pair_day(spark, sf_dir).groupBy("center").agg(F.corr("coherence", "dist_km").alias("r"), F.count("*").cast("double").alias("n"), (F.avg("coherence") / (F.stddev_samp("coherence") / F.sqrt(F.count("*")))).alias("t"))
    g = g.withColumn("f", F.expr("r * r * (n - 2) / (1 - r * r)"))
    return g.withColumns({"p_r": p_of_r("r", "n"), "p_t": p_of_t("t", F.col("n") - 1), "p_f": p_of_f("f", F.lit(1.0), F.col("n") - 2)})


@query("SELECT event_id, name, p_value FROM (SELECT event_id, 'p_value' AS name, round((event_id % 97) / 97.0::double, 6) AS p_value FROM events) q WHERE p_value BETWEEN 0 AND 1")
def nested_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p-values found at any depth of result documents."""
    e = read(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.struct(F.lit(1.5).alias("statistic"), F.round((F.col("event_id") % 97) / 97.0, 6).alias("p_value")).alias("test"))).alias("doc"))
    return p_values(e)


def _digits(n: str, width: int) -> str:
    return f"'0.' || lpad(cast({n} AS varchar({width})), {width}, '0')"


#: Result documents, one for each event: tests at several depths, and what looks like one but isn't.
DOCUMENT = " || ".join(
    [
        """'{"note":"see '""", "chr(92)", """'"p_value'""", "chr(92)", """'": 0.5","test":{"p_value":'""", _digits("event_id * 37 % 1000", 3), """',"statistic":'""", "cast(event_id % 7 AS varchar(1))", """'},"runs":[{"permutation_p_value":'""",
        _digits("event_id % 100", 2), """'},[{"p_value":1.5},{"deep":{"t_p_value":'""", _digits("event_id * 7 % 1000", 3), """',"t_statistic":-2}}]],"statistically_significant":'""",
        "CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END", """',"p_value":"0.01"}'""",
    ]
)
_tree = f"(SELECT event_id, event_type, t.* FROM (SELECT event_id, event_type, {DOCUMENT} AS doc FROM events) d, json_tree(d.doc) t)"
_beside = ", ".join(f"max(CASE WHEN b.key = '{s}' THEN cast(b.value AS double) END)" for s in ("statistic", "test_statistic", "t_statistic", "f_statistic"))
COLLECTED_SQL = f"""(SELECT a.event_id, a.event_type, a.fullkey AS path, a.key AS name, cast(a.value AS double) AS p_value, coalesce({_beside}) AS statistic
        FROM {_tree} a LEFT JOIN {_tree} b ON b.event_id = a.event_id AND b.parent = a.parent WHERE a.key ILIKE '%p_value%' AND a.type IN ('DOUBLE', 'UBIGINT', 'BIGINT') AND cast(a.value AS double) BETWEEN 0 AND 1 GROUP BY ALL
    UNION ALL SELECT event_id, event_type, fullkey, key, CASE WHEN cast(value AS varchar) = 'true' THEN 0.01 ELSE 0.10 END, CASE WHEN cast(value AS varchar) = 'true' THEN 1 ELSE 0 END FROM {_tree} c WHERE key = 'statistically_significant' AND type = 'BOOLEAN')"""


def result_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr("event_id", "event_type", f"{DOCUMENT} AS doc")


@query(f"SELECT event_id, path, name, {r('p_value')} AS p_value, {r('statistic')} AS statistic FROM {COLLECTED_SQL} z")
def collected_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tests that result documents report, at any depth, with the statistic beside each."""
    return select(collected_tests(result_documents(spark, sf_dir)), {"event_id": "event_id", "path": "path", "name": "name", "p_value": r("p_value"), "statistic": r("statistic")})


_family = {"tests": "count(*)", "raw": "cast(sum(CASE WHEN p_value < 0.05 THEN 1 ELSE 0 END) AS bigint)", "bonferroni": "cast(sum(CASE WHEN bonferroni < 0.05 THEN 1 ELSE 0 END) AS bigint)", "in_family": "cast(sum(CASE WHEN family_bonferroni < 0.05 THEN 1 ELSE 0 END) AS bigint)", "bh": "cast(sum(CASE WHEN bh < 0.05 THEN 1 ELSE 0 END) AS bigint)", "least_p": r("min(p_value)")}


@query(f"""SELECT family, {', '.join(f'{v} AS {k}' for k, v in _family.items())} FROM (SELECT family, p_value, least(1.0, p_value * m) AS bonferroni, least(1.0, p_value * f) AS family_bonferroni, least(1.0, min(p_value * m / k) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS bh
    FROM (SELECT event_type AS family, p_value, count(*) OVER () AS m, count(*) OVER (PARTITION BY event_type) AS f, row_number() OVER (ORDER BY p_value, event_type, event_id || path) AS k FROM {COLLECTED_SQL} c) q) z GROUP BY family""")
def collected_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a registry by family, corrected for all its tests and for those of the family."""
    tests = collected_tests(result_documents(spark, sf_dir)).select(F.col("event_type").alias("family"), F.concat(F.col("event_id").cast("string"), F.col("path")).alias("name"), "p_value")
    return select(significant_by_family(tests), {"family": "family", **{k: k for k in _family if k != "least_p"}, "least_p": r("least_p")})


@query("SELECT DISTINCT s_name AS name, s_name AS resolved FROM supplier")
def resolved_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    return resolve_codes(s.select(F.col("s_name").alias("name")).distinct(), s.select(F.col("s_name").alias("short_code")))


_tries = ["u", "substr(u, 1, 4)", "regexp_replace(u, '[0-9]', '', 'g')", "substr(u, 1, cast(greatest(length(u) - 3, 0) AS bigint))", "substr(u, 1, 3)"]
_known = "(SELECT DISTINCT upper(s_name) AS k, s_name AS v FROM supplier)"


@query(f"SELECT name, coalesce({', '.join(f't{k}.v' for k in range(5))}) AS resolved FROM (SELECT name, upper(name) AS u FROM (SELECT s_name AS name FROM supplier UNION SELECT c_name FROM customer) q) n {' '.join(f'LEFT JOIN {_known} t{k} ON t{k}.k = {x}' for k, x in enumerate(_tries))}")
def resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier's and customer's name looked up among the suppliers; unknown names resolve to null."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))
    names = s.unionByName(read(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))).distinct()
    return resolve_codes(names, s.withColumnRenamed("name", "short_code"))


@query(f"SELECT bool_and(kp_index BETWEEN 0 AND 9) AS kp_ok, bool_and(ap_index BETWEEN 0 AND 400) AS ap_ok, bool_and(f107_flux BETWEEN 50 AND 500) AS f107_ok, {r('corr(kp_index, f107_flux)', 4)} AS kp_f107_corr FROM {EXTERNAL_SQL} x")
def activity_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = validate_activity(external_daily(spark, sf_dir))
    return select(v, {"kp_ok": "kp_ok", "ap_ok": "ap_ok", "f107_ok": "f107_ok", "kp_f107_corr": r("kp_f107_corr", 4)})


_agreement = {"center": "center", "weighted": r("weighted", 1), "equal": r("equal", 1), "change": r("abs(equal - weighted) / weighted", 3), "consistent": "abs(equal - weighted) <= 2 * se_theta AND abs(equal - weighted) / weighted < 0.2"}
_equal = fit.fit_decay_sql(f"(SELECT *, 1 AS one FROM {bins_sql('center')} z)", ["center"], w="one")


@query(f"SELECT {', '.join(f'{v} AS {k}' for k, v in _agreement.items())} FROM (SELECT a.center, a.theta AS weighted, a.se_theta, b.theta AS equal FROM {ERRORS} a JOIN {_equal} b ON a.center = b.center WHERE a.amplitude > 0.0001 AND b.amplitude > 0.0001) s")
def cross_method_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted and equal-weight decay lengths of the centres that decay, side by side, within 20 % or not."""
    b = bins(spark, sf_dir, ["center"])
    a = fit.fit_decay(b, ["center"], errors=True).where("amplitude > 0.0001").select("center", F.col("theta").alias("weighted"), "se_theta")
    e = fit.fit_decay(b.withColumn("one", F.lit(1)), ["center"], w="one").where("amplitude > 0.0001").select("center", F.col("theta").alias("equal"))
    return select(a.join(e, "center"), _agreement)


@query()
def daily_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each year's daily join as one JSON document with an array a column."""
    d = daily(spark, sf_dir).join(external_daily(spark, sf_dir), "date").withColumn("year", F.year("date"))
    return as_columns(d, ["year"], "date", ["m", "n", "kp_index"])


@query(f"SELECT source, cast(floor(dist_km / 1000) AS int) AS km, count(*) AS n, {r('avg(v)')} AS mean_value FROM (SELECT 'real' AS source, dist_km, coherence AS v FROM {PAIR_DAY_SQL} a UNION ALL SELECT 'null', dist_km, cos(row % 1000 * 0.0062831853) FROM {PAIR_DAY_SQL} b) q GROUP BY 1, 2")
def real_against_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair_day(spark, sf_dir)
    u = p.selectExpr("'real' AS source", "dist_km", "coherence AS v").unionByName(p.selectExpr("'null' AS source", "dist_km", "cos(row % 1000 * 0.0062831853D) AS v"))
    return u.groupBy("source", F.floor(F.col("dist_km") / 1000).cast("int").alias("km")).agg(F.count("*").alias("n"), F.expr(r("avg(v)")).alias("mean_value"))
