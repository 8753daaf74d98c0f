"""Readers over small generated files; streaming equals batch."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from meshlag.sources import tables
from meshlag.streaming import rollups

LINES = """     3.00           C                                       RINEX VERSION
AR abcd 2024 01 02 00 00  0.000000  2   -0.123456789012E-07  0.1E-10
AR ABCD 2024 01 02 00 00 30.000000  1    0.200000000000E-07
AR EFGH 2024 01 02 00 00 30.000000  1    0.5
AR EFGH 2024 01 02 00 00 30.000000  1    0.7
AR BAD  2024 13 02 00 00 30.000000  1    0.7
AR SHORT 2024
AS G01  2024 01 02 00 00 30.000000  1    0.7
"""


def test_clock_files(spark, tmp_path):
    for name in ("COD0_20240020000_01D_CLK.CLK.gz", "COD0_20240030000_01D_CLK.CLK.gz", "ZZZ0_20240020000_01D_CLK.CLK.gz"):
        with gzip.open(tmp_path / name, "wt") as f:
            f.write(LINES)
    df = tables.read_clock_files(spark, str(tmp_path), "code")
    rows = df.where("obs_date = '2024-01-02'").orderBy("station", "ts", "bias").collect()
    assert [r["station"] for r in rows] == ["ABCD", "ABCD", "EFGH", "EFGH"]
    assert rows[0]["bias"] == -0.123456789012e-07 and rows[0]["drift"] == 0.1e-10 and rows[1]["drift"] is None
    assert df.count() == 8  # the second file of a date is left out
    assert tables.read_clock_files(spark, str(tmp_path), "code", start="2024-01-03").count() == 4
    assert tables.read_clock_files(spark, str(tmp_path), "code", most_files=1).count() == 4
    assert tables.duplicate_epochs(df.where("obs_date = '2024-01-02'")).count() == 1
    assert tables.average_epochs(df, ["obs_date", "station", "ts"]).where("station = 'EFGH'").first()["bias"] == 0.6


def test_catalogue(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"ABCD00USA": {"Latitude": 1.5, "Longitude": 350.0, "Height": 10.0, "X": 1.0, "Y": 2.0, "Z": 3.0}, "EFGH00DEU": {"Latitude": 0.0, "Longitude": 5.0, "Height": 0.0, "X": 0.0, "Y": 2.0, "Z": 3.0}}))
    rows = {r["code"]: r for r in tables.read_catalogue(spark, str(tmp_path / "s.json")).collect()}
    assert rows["ABCD00USA"]["lon_deg"] == -10 and rows["ABCD00USA"]["has_coordinates"] and rows["ABCD00USA"]["short_code"] == "ABCD"
    assert not rows["EFGH00DEU"]["has_coordinates"]


def test_codes(spark):
    stations = spark.createDataFrame([("ABCD",), ("XYZ",)], "short_code string")
    names = spark.createDataFrame([("abcd00usa",), ("XYZ12",), ("nope",), (None,)], "name string")
    got = {r["name"]: r["resolved"] for r in tables.resolve_codes(names, stations).collect()}
    assert got == {"abcd00usa": "ABCD", "XYZ12": "XYZ", "nope": None, None: None}


def test_kp(spark):
    line = "240102" + "259416" + "0003071013172023" + "x" * 10
    got = tables.parse_kp_lines(spark.createDataFrame([(line,), ("short",), ("99xx02" + " " * 30,)], "value string")).collect()
    assert len(got) == 1 and str(got[0]["date"]) == "2024-01-02"
    assert abs(got[0]["kp_index"] - sum(round(c * 0.3) / 3 for c in (0, 3, 7, 10, 13, 17, 20, 23)) / 8) < 1e-9


def test_activity_stays_null(spark):
    days = tables.calendar(spark, "2024-01-01", "2024-01-03")
    kp = spark.createDataFrame([("2024-01-02", 3.0)], "date string, kp_index double").withColumn("date", F.to_date("date"))
    flux = spark.createDataFrame([("2024-01-02", 120.0)], "date string, f107_flux double").withColumn("date", F.to_date("date"))
    assert tables.daily_activity(days, kp, flux).where("kp_index IS NULL").count() == 2
    assert tables.daily_activity(days, kp, flux, {"kp_index": 2.0}).where("kp_index = 2.0").count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A", "2024-01-02", 1, 2, 0.5)], "center string, date string, i int, j int, coherence double").withColumn("date", F.to_date("date"))
    tables.write_pairs(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).where("year_month = '2024-01'").count() == 1
    tables.write_csv(df, str(tmp_path / "c"))
    tables.write_json(df, str(tmp_path / "j"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == spark.read.json(str(tmp_path / "j")).count() == 1


def _rows(spark, k):
    return spark.range(200).selectExpr(f"'c{k % 2}' AS center", f"timestamp'2024-01-01' + make_interval(0, 0, 0, {k}, cast(id % 24 AS int)) AS ts", "'a' AS i", "'b' AS j", "60D + id * 40 AS dist_km", "cos(id) AS coherence")


def test_stream_equals_batch(spark, tmp_path):
    source, seen = str(tmp_path / "in"), {}
    for k in range(3):
        _rows(spark, k).write.mode("append").parquet(source)
    rollups.accumulate_bins(rollups.pair_stream(spark, source, 1), str(tmp_path / "cp"), lambda df, n: seen.update(last=df.collect())).awaitTermination()
    key = lambda rows: {(r["center"], r["bin"]): (r["n"], round(r["s1"], 9)) for r in rows}
    batch = rollups.bin_states(spark.read.parquet(source)).collect()
    assert key(seen["last"]) == key(batch)
    _rows(spark, 4).write.mode("append").parquet(source)  # a restart counts only what is new
    rollups.accumulate_bins(rollups.pair_stream(spark, source, 1), str(tmp_path / "cp"), lambda df, n: seen.update(last=df.collect())).awaitTermination()
    assert key(seen["last"]) == key(rollups.bin_states(spark.read.parquet(source)).collect())
    assert rollups.refit(spark.createDataFrame(seen["last"])).count() >= 0


def test_rollups(spark, tmp_path):
    source = str(tmp_path / "in")
    for k in (0, 9):
        _rows(spark, k).coalesce(1).write.mode("append").parquet(source)
    q = rollups.daily_rollup(rollups.pair_stream(spark, source, 1)).writeStream.format("memory").queryName("daily_t").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    assert spark.table("daily_t").where("n = 200").count() >= 1
    obs = rollups.pair_stream(spark, source, 1).selectExpr("ts", "i AS station", "coherence AS value")
    q = rollups.sliding_statistics(obs).writeStream.format("memory").queryName("slide_t").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    assert spark.table("slide_t").count() > 0


def _clock_file(path, lines, gz=True):
    body = "\n".join(lines).encode("latin-1")
    path.write_bytes(gzip.compress(body) if gz else body)


def test_clock_files_are_listed_not_opened(spark, tmp_path):
    """The first file of a date wins and dates narrow the list; a chosen file alone has to be readable."""
    good = [f"AR ABCD 2024 04 {k + 8:02d} 00 00 00.000000 2 -0.5E-07 0.1" for k in range(3)]
    for k in range(3):
        _clock_file(tmp_path / f"COD0OPSFIN_2024{99 + k:03d}0000_01D_30S_CLK.CLK.gz", [good[k]])
    (tmp_path / "ZZZ0OPSFIN_20240990000_01D_30S_CLK.CLK.gz").write_bytes(b"not gz, and second of its date")
    names = [p.rsplit("/", 1)[1] for p in tables.list_clock_files(spark, str(tmp_path))]
    assert names == [f"COD0OPSFIN_2024{99 + k:03d}0000_01D_30S_CLK.CLK.gz" for k in range(3)]
    assert len(tables.list_clock_files(spark, str(tmp_path), most_files=2)) == 2
    obs = tables.read_clock_files(spark, str(tmp_path), "COD", start="2024-04-09", end="2024-04-09").collect()
    assert [(str(r["obs_date"]), r["station"], r["bias"]) for r in obs] == [("2024-04-09", "ABCD", -0.5e-07)]
    assert tables.read_clock_files(spark, str(tmp_path), "COD", start="2030-01-01").count() == 0


def test_damaged_and_latin_files(spark, tmp_path):
    """A cut gz gives what it still yields, others are unharmed; bytes that are not UTF-8 are Latin-1."""
    lines = [f"AR ST{k % 90:02d} 2024 04 08 {k // 60 % 24:02d} {k % 60:02d} 00.000000 1 {k}.5" for k in range(20_000)]
    body = gzip.compress("\n".join(lines).encode(), compresslevel=1)
    (tmp_path / "COD0OPSFIN_20240990000_01D_30S_CLK.CLK.gz").write_bytes(body[: len(body) // 2])
    _clock_file(tmp_path / "COD0OPSFIN_20241000000_01D_30S_CLK.CLK", ["COMMENT \xe9t\xe9", "AR ZIMM\xc9 2024 04 09 00 00 00.000000 1 2.5", "AR GOOD 2024 04 09 00 00 00.000000 1 1.5"], gz=False)
    obs = tables.read_clock_files(spark, str(tmp_path), "COD").collect()
    cut = [r for r in obs if str(r["obs_date"]) == "2024-04-08"]
    assert len(cut) < len(lines)
    assert {(r["station"], r["bias"]) for r in obs if str(r["obs_date"]) == "2024-04-09"} == {("ZIMM\xc9", 2.5), ("GOOD", 1.5)}


def test_stored_pairs_prune(spark, tmp_path):
    rows = [(c, f"2024-0{m}-15", 1, 2, 0.5) for c in "ABC" for m in range(1, 5)]
    df = spark.createDataFrame(rows, "center string, date string, i int, j int, coherence double").withColumn("date", F.to_date("date"))
    path = str(tmp_path / "p")
    tables.write_pairs(df, path)
    part = tables.read_pairs(spark, path, ["A", "C"], "2024-02-15", "2024-03-14")
    assert sorted(part.columns) == sorted(df.columns) and {(r["center"], str(r["date"])) for r in part.collect()} == {("A", "2024-02-15"), ("C", "2024-02-15")}
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "year_month" in plan.split("PartitionFilters")[1][:300] and "center" in plan.split("PartitionFilters")[1][:300]
    assert tables.read_pairs(spark, path).count() == 12


def test_places_by_any_name(spark):
    rows = [(1, 10.0, None, 20.0, None, None, None, None), (2, None, -5.0, None, 30.0, 1.0, 2.0, 3.0), (3, None, None, None, None, 6378137.0, 0.0, 0.0), (4, 1.0, None, None, None, None, None, None), (5, None, None, None, None, 0.0, 0.0, 6356752.314245)]
    s = spark.createDataFrame(rows, "id int, lat double, lat_deg double, lon double, longitude double, X double, Y double, Z double")
    got = {r["id"]: (r["place_lat"], r["place_lon"]) for r in tables.with_places(s).collect()}
    assert got[1] == (10.0, 20.0) and got[2] == (-5.0, 30.0) and got[3] == (pytest.approx(0.0, abs=1e-9), 0.0) and got[4] == (None, None) and got[5][0] == pytest.approx(90.0)
    bare = tables.with_places(spark.createDataFrame([(1, 3.0, 4.0)], "id int, latitude double, lon_deg double")).first()
    assert (bare["place_lat"], bare["place_lon"]) == (3.0, 4.0)


def test_collected_tests(spark):
    """Every level is walked; text in strings, strings as values, nulls, out of range numbers and broken documents give nothing."""
    from meshlag.sources.tables import collected_tests, p_values, walk

    docs = [
        (1, '{"a": {"p_value": 0.25, "statistic": 3}, "list": [[{"t_pvalue": 1e-3, "t_statistic": -2.5}], 7], "note": "\\"p_value\\": 0.5"}'),
        (2, '{"p_value": "0.01", "q": {"p_value": null}, "r": {"p_value": 1.5}, "statistically_significant": true, "s": {"statistically_significant": false}, "t": {"statistically_significant": "yes"}}'),
        (3, "{broken"), (4, None), (5, "[]"), (6, '{"p_value": {"p_value": 1}}'), (7, "3"),
    ]
    df = spark.createDataFrame(docs, "id long, doc string")
    got = sorted((x["id"], x["path"], x["name"], x["p_value"], x["statistic"]) for x in collected_tests(df).collect())
    want = [(1, "$.a.p_value", "p_value", 0.25, 3.0), (1, "$.list[0][0].t_pvalue", "t_pvalue", 0.001, -2.5), (2, "$.s.statistically_significant", "statistically_significant", 0.1, 0.0), (2, "$.statistically_significant", "statistically_significant", 0.01, 1.0), (6, "$.p_value.p_value", "p_value", 1.0, None)]
    assert got == want
    assert sorted((x["id"], x["p_value"]) for x in p_values(df).collect()) == [(1, 0.001), (1, 0.25), (6, 1.0)]
    assert walk(df.where("id > 2 AND id < 6")).count() == 0


def test_significant_by_family(spark):
    """Counts over ranges equal those of the adjusted values."""
    import random

    from meshlag.operators.stats import correct, significant_by_family

    r = random.Random(2)
    rows = [(r.choice("abc"), f"t{k}", r.choice([r.random(), r.random() ** 6, 0.01, None])) for k in range(400)]
    df = spark.createDataFrame(rows, "family string, name string, p_value double")
    want = {}
    for x in correct(df).collect():
        have = want.setdefault(x["family"], [0] * 5)
        for k, v in enumerate((True, x["p_value"] < 0.05, x["bonferroni"] < 0.05, x["family_bonferroni"] < 0.05, x["bh"] < 0.05)):
            have[k] += v
    assert {x["family"]: [x[c] for c in ("tests", "raw", "bonferroni", "in_family", "bh")] for x in significant_by_family(df).collect()} == want
    assert significant_by_family(df.limit(0)).count() == 0
