"""Graphs, autocorrelation, cycles and the closed form of p against plain versions."""

import math
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlag.operators import network, resample, stats
from meshlag.sources.tables import write_by_station
from meshlag.streaming import rollups


def _brute(edges):
    plain = {tuple(sorted(e)) for e in edges if None not in e and e[0] != e[1]}
    near = {}
    for a, b in plain:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for v, around in near.items():
        t = sum(tuple(sorted(p)) in plain for p in combinations(around, 2))
        out[v] = len(around), t, 2 * t / (len(around) * (len(around) - 1)) if len(around) > 1 else None
    return out


def test_clustering(spark):
    """Two graphs, one with a hub that meets every node, repeated and reversed edges, loops and null ends."""
    rng = np.random.default_rng(3)
    graphs = {"x": [tuple(map(int, rng.integers(0, 30, 2))) for _ in range(160)] + [(0, k) for k in range(40)], "y": [(1, 2), (2, 1), (2, 3), (3, 3), (None, 1), (7, 8), (8, 9), (9, 7)]}
    edges = spark.createDataFrame([(g, a, b) for g, e in graphs.items() for a, b in e], "center string, i long, j long")
    got = {}
    for x in network.clustering(edges, ["center"]).collect():
        got.setdefault(x["center"], {})[x["node"]] = x["degree"], x["triangles"], x["clustering"]
    for g, e in graphs.items():
        want = _brute(e)
        assert got[g].keys() == want.keys()
        for v, (d, t, c) in want.items():
            assert got[g][v][:2] == (d, t) and (got[g][v][2] is None if c is None else got[g][v][2] == pytest.approx(c))
    assert network.clustering(edges.limit(0), ["center"]).count() == 0


def test_autocorrelation(spark):
    """A gap stays a gap, null values drop out, a constant series has no r."""
    rng = np.random.default_rng(5)
    series = {k: float(v) for k, v in enumerate(rng.normal(size=90)) if k not in (17, 40, 41)}
    rows = [("a", k, v) for k, v in series.items()] + [("a", 17, None)] + [("c", k, 2.0) for k in range(9)]
    got = {(x["g"], x["lag"]): (x["r"], x["n"]) for x in network.autocorrelation(spark.createDataFrame(rows, "g string, t long, y double"), ["g"], "t", "y", 12).collect()}
    mean, square = np.mean(list(series.values())), sum((v - np.mean(list(series.values()))) ** 2 for v in series.values())
    for lag in range(1, 13):
        both = [(v - mean) * (series[k + lag] - mean) for k, v in series.items() if k + lag in series]
        assert got["a", lag][0] == pytest.approx(sum(both) / square) and got["a", lag][1] == len(both)
    assert got["c", 3] == (None, 6)


def test_cycles(spark):
    """The planted cycle and its part are found; whole days and constant series have none."""
    d = np.arange(0, 2800, 7)
    rows = [("a", int(k), float(0.5 * np.cos(2 * np.pi * k / 365.25) + 0.01 * math.sin(k))) for k in d] + [("c", int(k), 1.0) for k in d] + [("s", 7, 1.0), ("s", 14, 3.0), ("s", 21, None)]
    got = {(x["g"], x["period"]): x for x in network.cycles(spark.createDataFrame(rows, "g string, d long, y double"), ["g"], "d", "y", (365.25, 433.0, 1.0)).collect()}
    assert got["a", 365.25]["component"] == "cosine" and got["a", 365.25]["r"] == pytest.approx(np.corrcoef([v for g, _, v in rows if g == "a"], np.cos(2 * np.pi * (d / 365.25 % 1)))[0, 1])
    assert abs(got["a", 433.0]["r"]) < got["a", 365.25]["r"] and got["s", 365.25]["n"] == 2
    assert all(got[k]["r"] is None and got[k]["component"] is None for k in (("a", 1.0), ("c", 365.25), ("s", 365.25)))


def test_closed_form_of_p():
    for n in (3, 4, 5, 6, 11, 12, 101, 2500):
        for r in (0.0, 0.01, -0.2, 0.5, -0.93):
            got = duckdb.sql(f"SELECT {network.p_of_r_sql('r', 'n')} FROM (SELECT {r}::double AS r, {n}::bigint AS n)").fetchall()[0][0]
            assert got == pytest.approx(stats.t_p_value(r * math.sqrt((n - 2) / (1 - r * r)), n - 2), abs=1e-9)


def test_stored_by_station(spark):
    """Sums by station from the buckets equal those of the facts, and need no exchange."""
    rng = np.random.default_rng(2)
    rows = [(int(a), int(b), int(rng.integers(0, 5)), float(rng.normal()), 100.0) for a, b in rng.integers(0, 12, (400, 2)) if a != b]
    pairs = spark.createDataFrame(rows, "i long, j long, bin int, coherence double, dist_km double")
    write_by_station(pairs, "stored_pairs_test", 4)
    got = resample.by_stored_station(spark.table("stored_pairs_test"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    key = lambda df: {(x["station"], x["bin"]): (x["n"], round(x["s1"], 9)) for x in df.collect()}
    assert key(got) == key(resample.by_station(pairs))
    spark.sql("DROP TABLE stored_pairs_test")


def test_buckets_are_written_by_many(spark):
    """No task writes a whole bucket; the facts stand under each of their ends once."""
    rows = [(a, b, 1, 1.0, 100.0) for a in range(12) for b in range(a + 1, 40)] + [(3, 3, 1, 1.0, 0.0)]
    write_by_station(spark.createDataFrame(rows, "i long, j long, bin int, coherence double, dist_km double"), "many_parts_test", 4)
    stored = spark.table("many_parts_test")
    assert len(stored.inputFiles()) > 100 and stored.columns == ["i", "j", "bin", "coherence", "dist_km", "station"]
    want = sorted([(a, b, e) for a, b, *_ in rows[:-1] for e in (a, b)] + [(3, 3, 3)])
    assert sorted((r["i"], r["j"], r["station"]) for r in stored.collect()) == want
    spark.sql("DROP TABLE many_parts_test")


def test_closed_days(spark, tmp_path):
    """A day comes once, after the watermark; its median is exact for few values and near for many."""
    source, rng = str(tmp_path / "in"), np.random.default_rng(8)
    day = {1: rng.normal(size=150), 2: rng.normal(size=20_000), 5: rng.normal(size=3), 9: np.array([1.0])}
    for k, values in day.items():
        rows = [("A", f"2020-01-{k:02} 10:00:00", "p", "q", 1.0, float(v)) for v in values] + [("A", f"2020-01-{k:02} 11:00:00", "p", "q", 1.0, None)]
        spark.createDataFrame(rows, "center string, ts string, i string, j string, dist_km double, coherence double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(source)
    q = rollups.closed_days(rollups.pair_stream(spark, source, 1)).writeStream.format("memory").queryName("closed_t").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    got = {x["day"].day: x for x in spark.table("closed_t").collect()}
    assert sorted(got) == [1, 2, 5] and spark.table("closed_t").count() == 3
    assert got[1]["median"] == np.sort(day[1])[74] and got[5]["median"] == np.sort(day[5])[1] and got[1]["n"] == 151
    assert abs(np.mean(day[2] < got[2]["median"]) - 0.5) < 0.03


def test_closed_days_exact(spark, tmp_path):
    """Medians of thousands of values are exact, as they are and rounded to digits; none of a day without values."""
    source, rng = str(tmp_path / "in"), np.random.default_rng(9)
    values = np.round(np.cos(rng.uniform(0, 7, 5_000)), 9)
    days = [("A", "2020-01-01", v) for v in values] + [("B", "2020-01-01", v) for v in values[:4]] + [("C", "2020-01-01", None), ("A", "2020-01-09", 0.5)]
    for k in (1, 9):
        rows = [(c, f"{d} 10:00:00", "p", "q", 1.0, None if v is None else float(v)) for c, d, v in days if d.endswith(str(k))]
        spark.createDataFrame(rows, "center string, ts string, i string, j string, dist_km double, coherence double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(source)
    for digits in (None, 5):
        name = f"exact_{digits}"
        q = rollups.closed_days(rollups.pair_stream(spark, source, 1), digits=digits).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
        got = {x["center"]: x["median"] for x in spark.table(name).collect()}
        want = {"A": np.sort(values)[2_499], "B": np.sort(values[:4])[1]}
        assert got == {"C": None, **{c: float(v) if digits is None else round(float(v), digits) for c, v in want.items()}}


def test_staged_arrivals(spark, tmp_path):
    """Arrivals follow each other in time and are written by many tasks; few times make few arrivals."""
    from meshlag.plans import streams

    rows = spark.range(4_000).selectExpr("timestamp_seconds(id * 1000 % 4001) AS ts", "id")
    paths = streams._stage(rows, str(tmp_path / "a"), "ts", 4)
    held = [(*spark.read.parquet(p).selectExpr("min(ts)", "max(ts)", "count(*)").first(), len(spark.read.parquet(p).inputFiles())) for p in paths]
    assert sum(h[2] for h in held) == 4_000 and all(a[1] < b[0] for a, b in zip(held, held[1:]))
    assert all(600 < h[2] < 1400 and h[3] >= streams.FILES // 4 - 2 for h in held)
    from meshlag.streaming import rollups

    few = spark.createDataFrame([("A", "2020-01-01", 300.0, 0.5), ("A", "2020-01-02", 300.0, 0.25)], "center string, ts string, dist_km double, coherence double").withColumn("ts", F.to_timestamp("ts"))
    got = streams._drain(few, "ts", rollups.bin_states, arrivals=4).collect()
    assert [(r["s1"], r["n"]) for r in got] == [(0.75, 2)]
