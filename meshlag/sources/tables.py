"""Readers and writers: clock files, station catalogue, activity indices, result documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshlag.functions import geo
from meshlag.functions.cut import cut
from meshlag.operators.steps import apply

CLOCK_SCHEMA = T.StructType([T.StructField("center", T.StringType()), T.StructField("obs_date", T.DateType()), T.StructField("station", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("bias", T.DoubleType()), T.StructField("drift", T.DoubleType())])
PAIR_SCHEMA = T.StructType([T.StructField("center", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("i", T.StringType()), T.StructField("j", T.StringType()), T.StructField("dist_km", T.DoubleType()), T.StructField("coherence", T.DoubleType())])


def file_date(path: Column) -> Column:
    """Date from year and day of the year in a file name (the first run YYYYDDD after an underscore)."""
    year, doy = (F.regexp_extract(path, r"_(\d{4})(\d{3})", g).cast("int") for g in (1, 2))
    return F.when(year.isNotNull(), F.date_add(F.make_date(year, F.lit(1), F.lit(1)), doy - 1))


def parse_clock_lines(lines: DataFrame) -> DataFrame:
    """Rows of `AR` records from a column `value`: full floating-point values, exponents and all.

    Malformed records give null fields and are dropped; stations are upper-cased; the drift is optional.
    """
    parts = lines.where(F.col("value").startswith("AR ")).withColumn("p", F.split(F.trim("value"), r"\s+"))
    at = lambda k: F.try_element_at("p", F.lit(k))
    num = lambda k, kind="double": at(k).try_cast(kind)
    ts = F.try_make_timestamp(num(3, "int"), num(4, "int"), num(5, "int"), num(6, "int"), num(7, "int"), at(8).try_cast("decimal(16,6)"))
    return parts.select(*[c for c in lines.columns if c != "value"], F.upper(at(2)).alias("station"), ts.alias("ts"), num(10).alias("bias"), num(11).alias("drift")).where("station IS NOT NULL AND ts IS NOT NULL AND bias IS NOT NULL")


def list_clock_files(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, most_files: int | None = None) -> list[str]:
    """Paths of the clock files to read, by date. Files are listed, not opened.

    Dates come from the file names; the first file of a date wins; `start`/`end` and `most_files` (a number of
    dates) narrow the list. The driver holds one path for each day.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file")).withColumn("obs_date", file_date(F.col("file")))
    if start:
        files = files.where(F.col("obs_date") >= F.lit(start).cast("date"))
    if end:
        files = files.where(F.col("obs_date") <= F.lit(end).cast("date"))
    first = files.groupBy("obs_date").agg(F.min("file").alias("file")).orderBy("obs_date")
    return [r["file"] for r in (first if most_files is None else first.limit(most_files)).collect()]


def read_clock_files(spark: SparkSession, path: str, center: str, start: str | None = None, end: str | None = None, most_files: int | None = None) -> DataFrame:
    """Clock observations of gz or plain text files, one task a file; only the files of `list_clock_files` are opened.

    A line that is not UTF-8 is read as Latin-1. What a damaged or cut gz file still yields is kept, the rest of
    it is lost.
    """
    chosen = list_clock_files(spark, path, start, end, most_files)
    if not chosen:
        return spark.createDataFrame([], CLOCK_SCHEMA)
    raw = spark.read.option("ignoreCorruptFiles", "true").text(chosen)
    line = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    lines = raw.select(line.alias("value"), F.lit(center).alias("center"), file_date(F.input_file_name()).alias("obs_date"))
    return parse_clock_lines(lines).select(CLOCK_SCHEMA.fieldNames())


def duplicate_epochs(obs: DataFrame) -> DataFrame:
    """(station, ts, n) of epochs that occur more than once, for strict pivots."""
    return obs.groupBy("station", "ts").agg(F.count("*").alias("n")).where("n > 1")


def average_epochs(obs: DataFrame, keys: list[str]) -> DataFrame:
    return obs.groupBy(*keys).agg(F.avg("bias").alias("bias"))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Stations from one JSON object keyed by a nine-character code, longitudes wrapped to +-180."""
    entry = "struct<Latitude:double,Longitude:double,Height:double,X:double,Y:double,Z:double>"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("code", "s"))
    lon = F.when(F.col("s.Longitude") > 180, F.col("s.Longitude") - 360).otherwise(F.col("s.Longitude"))
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))) & (c != 0)
    return raw.select("code", F.upper(F.substring("code", 1, 4)).alias("short_code"), F.col("s.Latitude").alias("lat_deg"), lon.alias("lon_deg"), F.col("s.Height").alias("height_m"), "s.X", "s.Y", "s.Z", (good(F.col("s.X")) & good(F.col("s.Y")) & good(F.col("s.Z"))).alias("has_coordinates"))


#: Names under which a latitude and a longitude may come, the first present value counts; and of geocentric metres.
LATITUDES, LONGITUDES, METRES = ("lat", "lat_deg", "latitude"), ("lon", "lon_deg", "longitude"), (("X", "Y", "Z"), ("x_m", "y_m", "z_m"))


def with_places(stations: DataFrame) -> DataFrame:
    """Adds place_lat and place_lon: the given degrees under any of their names, else those of the geocentric metres."""
    have = set(stations.columns)
    first = lambda names: F.coalesce(*[F.col(c).cast("double") for c in names if c in have], F.lit(None).cast("double"))
    metres = next((m for m in METRES if have >= set(m)), None)
    out = stations.withColumns({"_lat": first(LATITUDES), "_lon": first(LONGITUDES)})
    given = F.col("_lat").isNotNull() & F.col("_lon").isNotNull()
    if metres is None:
        return out.withColumns({"place_lat": F.when(given, F.col("_lat")), "place_lon": F.when(given, F.col("_lon"))}).drop("_lat", "_lon")
    steps = geo.ecef_closed_form(*metres)
    made = [c for step in steps for c in step]
    out = apply(out, steps).withColumns({"place_lat": F.when(given, F.col("_lat")).otherwise(F.col("lat_closed")), "place_lon": F.when(given, F.col("_lon")).otherwise(F.col("lon_closed"))})
    return out.drop("_lat", "_lon", *made)


def first_by_code(stations: DataFrame, code: str = "short_code", order: str = "code") -> DataFrame:
    return stations.withColumn("r", F.row_number().over(Window.partitionBy(code).orderBy(order))).where("r = 1").drop("r")


def resolve_codes(names: DataFrame, stations: DataFrame, name: str = "name", code: str = "short_code") -> DataFrame:
    """Fuzzy lookup: full name, first four, without digits, less the last three, first three; the first hit wins."""
    u = F.upper(F.col(name))
    tries = F.array(u, F.substring(u, 1, 4), F.regexp_replace(u, r"\d", ""), F.expr(f"substring(upper({name}), 1, greatest(length({name}) - 3, 0))"), F.substring(u, 1, 3))
    options = names.select(name, F.posexplode(tries).alias("priority", "try"))
    hits = options.join(stations.select(F.upper(code).alias("try"), F.col(code).alias("resolved")).distinct(), "try")
    best = hits.groupBy(name).agg(F.min_by("resolved", "priority").alias("resolved"))
    return names.join(best, name, "left")


def parse_kp_lines(lines: DataFrame) -> DataFrame:
    """Daily mean Kp from fixed-width lines: YYMMDD in columns 1-6, eight two-digit codes in columns 13-28."""
    v = F.col("value")
    codes = F.array(*[F.substring(v, 13 + 2 * k, 2).try_cast("int") for k in range(8)])
    yy = F.substring(v, 1, 2).try_cast("int")
    day = F.try_make_timestamp(F.when(yy < 32, yy + 2000).otherwise(yy + 1900), F.substring(v, 3, 2).try_cast("int"), F.substring(v, 5, 2).try_cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    thirds = F.transform(codes, lambda c: F.round(c * 0.3) / 3)
    mean = F.aggregate(thirds, F.lit(0.0), lambda a, x: a + x) / 8
    return lines.where(F.length("value") >= 28).select(day.alias("date"), mean.alias("kp_index")).where("date IS NOT NULL AND kp_index IS NOT NULL")


def read_flux(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    rows = spark.read.schema("time_tag string, flux double").json(path, multiLine=True)
    return rows.select(F.to_date(F.substring("time_tag", 1, 10)).alias("date"), F.col("flux").alias("f107_flux")).where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))


def daily_activity(days: DataFrame, kp: DataFrame, flux: DataFrame, fill: dict[str, float] | None = None) -> DataFrame:
    """Calendar with the observed indices; what was not observed stays null unless `fill` says otherwise."""
    out = days.join(kp, "date", "left").join(flux, "date", "left")
    return out.fillna(fill) if fill else out


def validate_activity(df: DataFrame) -> DataFrame:
    """One row: are the indices in range, and do Kp and flux move together?"""
    return df.agg(F.expr("coalesce(bool_and(kp_index BETWEEN 0 AND 9), true)").alias("kp_ok"), F.expr("coalesce(bool_and(ap_index BETWEEN 0 AND 400), true)").alias("ap_ok"), F.expr("coalesce(bool_and(f107_flux BETWEEN 50 AND 500), true)").alias("f107_ok"), F.corr("kp_index", "f107_flux").alias("kp_f107_corr"))


def walk(documents: DataFrame, column: str = "doc") -> DataFrame:
    """(other columns, path, key, value, parent): every member of nested JSON text at any depth, value and parent as VARIANT.

    Text is parsed once; a level of nesting is one explosion of the objects and arrays of the level above, which
    are written in between, so there are as many steps as the deepest document has levels. Text inside strings is
    never taken for structure. Null and malformed documents have no members; an array's members have no key.
    """
    spark, others = documents.sparkSession, [c for c in documents.columns if c != column]
    level = documents.select(*others, F.lit("$").alias("path"), F.try_parse_json(column).alias("parent")).where("parent IS NOT NULL")
    found = []
    while True:
        members = level.lateralJoin(spark.tvf.variant_explode(F.col("parent").outer()))
        path = F.concat("path", F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.col("key"))).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))))
        rows = cut(members.select(*others, path.alias("path"), "key", "value", "parent"))
        found.append(rows)
        level = rows.where(F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)<")).select(*others, "path", F.col("value").alias("parent"))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)


#: The p-value that a bare verdict stands for.
VERDICT_P = {True: 0.01, False: 0.10}
STATISTICS = ("statistic", "test_statistic", "t_statistic", "f_statistic")


def collected_tests(documents: DataFrame, column: str = "doc") -> DataFrame:
    """(other columns, path, name, p_value, statistic): the tests that nested result documents report.

    A number from 0 to 1 under a key that names a p-value is a test, with the statistic that stands beside it. A
    boolean `statistically_significant` is one too, with the p-value of such a verdict and 1 or 0 as statistic.
    Numbers inside strings and p-values written as strings are none.
    """
    others = [c for c in documents.columns if c != column]
    members = walk(documents, column).where("key IS NOT NULL").withColumn("_kind", F.schema_of_variant("value"))
    named = F.col("key").rlike("(?i)p_?value") & F.col("_kind").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    beside = F.coalesce(*[F.try_variant_get("parent", f"$.{s}", "double") for s in STATISTICS])
    numbers = members.where(named).select(*others, "path", F.col("key").alias("name"), F.try_variant_get("value", "$", "double").alias("p_value"), beside.alias("statistic"))
    verdicts = members.where((F.col("key") == "statistically_significant") & (F.col("_kind") == "BOOLEAN")).withColumn("_v", F.try_variant_get("value", "$", "boolean"))
    judged = verdicts.select(*others, "path", F.col("key").alias("name"), F.when(F.col("_v"), VERDICT_P[True]).otherwise(VERDICT_P[False]).alias("p_value"), F.col("_v").cast("int").cast("double").alias("statistic"))
    return numbers.where("p_value BETWEEN 0 AND 1").unionByName(judged)


def p_values(documents: DataFrame, column: str = "doc") -> DataFrame:
    """(other columns, name, p_value): every number from 0 to 1 under a key that names a p-value in nested JSON text."""
    others = [c for c in documents.columns if c != column]
    return collected_tests(documents, column).where("name <> 'statistically_significant'").select(*others, "name", "p_value")


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Pair facts as Parquet by centre and month; later scans prune by both."""
    pairs.withColumn("year_month", F.date_format("date", "yyyy-MM")).repartition("center", "year_month").write.mode("overwrite").partitionBy("center", "year_month").parquet(path)


def read_pairs(spark: SparkSession, path: str, centers: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Pair facts as `write_pairs` stored them; folders of other centres and months are not read."""
    pairs = spark.read.parquet(path)
    if centers is not None:
        pairs = pairs.where(F.col("center").isin(centers))
    for day, keep in ((start, lambda c, v: c >= v), (end, lambda c, v: c <= v)):
        if day:
            pairs = pairs.where(keep(F.col("year_month"), day[:7]) & keep(F.col("date"), F.lit(day).cast("date")))
    return pairs.drop("year_month")


#: Tasks that sort and write the buckets; Spark's shuffle writers keep no rows in memory up to 200.
WRITERS = 192


def write_by_station(pairs: DataFrame, table: str, buckets: int = 64) -> None:
    """Pair facts as a table in buckets of the column `station`, sorted by it; a fact stands under each of its ends.

    Sums, leave-outs and joins by station then read each bucket where it lies: they need no exchange. The facts
    are moved once here, in parts of a station by its partner, so that no task sorts a whole bucket: a bucket
    has several files. A station with a large share of all facts makes a large bucket, which is summed as it is
    read; files of it are split for reading only where sums are taken by a shuffle.
    """
    parts = max(1, WRITERS // buckets)
    both = pairs.withColumn("station", F.explode(F.array_distinct(F.array("i", "j")))).withColumn("_part", F.pmod(F.xxhash64("i", "j"), F.lit(parts)))
    both = both.repartition(buckets * parts, "station", "_part").drop("_part")
    both.write.bucketBy(buckets, "station").sortBy("station").mode("overwrite").saveAsTable(table)


def write_csv(df: DataFrame, path: str) -> None:
    """A small result table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def as_columns(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """A JSON document for each key with one ordered array a column; for small series."""
    rows = F.array_sort(F.collect_list(F.struct(order, *values)))
    packed = df.groupBy(*keys).agg(rows.alias("r"))
    return packed.select(*keys, F.to_json(F.struct(F.col(f"r.{order}").alias(order), *[F.col(f"r.{v}").alias(v) for v in values])).alias("doc"))
