"""Readers and reshaping of landed files: station CSV, nested JSON, array documents, fires."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline.constants import STATION_COLUMNS
from hazeline.functions.clock import micros, to_local
from hazeline.functions.text import canonical_column, csv_fields, join_labels, station_from_filename
from hazeline.operators.cleaning import coerce_numeric
from hazeline.operators.ordered import HOUR_US, first_rows
from hazeline.session import broadcast_small, durable

STATION_SCHEMA = "id string, name string, lat double, lon double"
FIRE_SCHEMA = (
    "latitude double, longitude double, bright_ti4 double, scan double, track double, acq_date string, "
    "acq_time string, satellite string, confidence string, version string, bright_ti5 double, "
    "frp double, daynight string"
)
_STAMP = "struct<utc:string,local:string>"
HOUR_DOCUMENT = (
    "results array<struct<value:double,"
    f"period:struct<datetimeFrom:{_STAMP},datetimeTo:{_STAMP},interval:string>,"
    "coverage:struct<percentComplete:double,observedCount:double>,"
    f"datetime:{_STAMP}>>, _corrupt string"
)


def _require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def scan_stations(spark: SparkSession, path: str) -> DataFrame:
    """Station registry file; all four columns are required."""
    header = spark.read.option("header", True).csv(path)
    _require(header, ["id", "name", "lat", "lon"])
    return header.select("id", "name", F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon"))


def scan_breakpoints(spark: SparkSession, path: str) -> DataFrame:
    """Breakpoint file with its six required columns."""
    header = spark.read.option("header", True).csv(path)
    _require(header, ["pollutant", "conc_low", "conc_high", "index_low", "index_high", "category"])
    doubles = ["conc_low", "conc_high", "index_low", "index_high"]
    return header.withColumns({c: F.col(c).try_cast("double") for c in doubles})


def station_headers(lines: DataFrame) -> DataFrame:
    """(path, header, at, found) per file of `lines` (path, start, value, order): its first line, the place of the
    timestamp and the place of each canonical column (0 where it is absent)."""
    first = lines.where("start = 0").groupBy("path").agg(F.min_by("value", "order").alias("header"))
    names = F.transform(csv_fields(F.regexp_replace("header", "^\ufeff", "")), lambda x: F.trim(x))
    first = first.withColumn("names", names).withColumn("known", F.transform("names", canonical_column))
    places = F.struct(*[F.array_position("known", c).alias(c) for c in STATION_COLUMNS])
    return first.select("path", "header", F.array_position(F.transform("names", F.lower), "timestamp").alias("at"), places.alias("found"))


def scan_obs_csv(spark: SparkSession, directory: str, named: bool = False) -> DataFrame:
    """Station CSV files whose headers differ; the station comes from the file name.

    With `named` the files lie below folders `file=<name>`, as Spark writes them, and that is their name.

    One plan for any number of layouts: the first line of each file says where its columns are, this
    small table meets the lines by their file (by broadcast where it is small), and a line is split once
    and picked from by position. Blank lines and repeated headers are left out. A file without a
    timestamp column is an error that names the file. Fields do not span lines.
    """
    path = F.col("_metadata.file_path")
    source = spark.read.option("recursiveFileLookup", named).option("pathGlobFilter", "*.csv").text(directory)
    file = F.regexp_extract(path, "/file=([^/]+)/", 1) if named else F.col("_metadata.file_name")
    lines = source.select(
        "value", path.alias("path"), file.alias("file"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("order"))
    heads = durable(station_headers(lines))
    rows = lines.select("path", "file", "value").where(F.trim("value") != "").join(broadcast_small(heads), "path").where("value <> header")
    no_time = F.raise_error(F.concat(F.lit("no Timestamp column in "), F.col("path"))).cast("string")
    rows = rows.withColumn("fields", csv_fields(F.col("value")))

    def picked(place: Column) -> Column:
        return F.when(place > 0, F.get("fields", (place - 1).cast("int")))

    out = rows.select(
        to_local(F.when(F.col("at") > 0, picked(F.col("at"))).otherwise(no_time), naive="IST").alias("ts"),
        station_from_filename(F.col("file")).alias("station"), *[picked(F.col(f"found.{c}")).alias(c) for c in STATION_COLUMNS])
    return coerce_numeric(out, list(STATION_COLUMNS)).select("ts", "station", *STATION_COLUMNS)


def series_of_file(file: Column) -> Column:
    """struct(station, parameter) of `<station>_<parameter>_<from>_<to>.json`, read from the right; null for other names."""
    words = F.split(F.regexp_replace(file, "[.]json$", ""), "_")
    dates = F.element_at(words, -1).rlike("^[0-9]{8}$") & F.element_at(words, -2).rlike("^[0-9]{8}$")
    right = file.endswith(".json") & (F.size(words) > 3) & dates & F.element_at(words, -3).rlike("^pm[0-9]+$")
    station = F.array_join(F.slice(words, F.lit(1), F.greatest(F.lit(0), F.size(words) - 3)), "_")
    return F.when((F.size(words) > 3) & right, F.struct(station.alias("station"), F.element_at(words, -3).alias("parameter")))


def hour_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per record of `results`; unreadable documents are skipped.

    The period start is the time, the plain stamp stands in; UTC text is preferred.
    """
    rows = docs.where("_corrupt IS NULL").select(*keep, F.posexplode("results").alias("position", "r"))
    return rows.select(
        *keep,
        to_local(stamp_text(F.col("r.period.datetimeFrom"), F.col("r.datetime"))).alias("ts"),
        F.col("r.value").alias("value"), F.col("r.coverage.percentComplete").alias("coverage"), "position",
    )


def _named_json(spark: SparkSession, directory: str, schema: str, named: bool) -> DataFrame:
    """One document per file, with its `file` name; damaged ones keep their text in `_corrupt`.

    With `named` the documents lie one folder down, in folders `file=<name>` as Spark writes them.
    """
    read = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    if named:
        return read.schema(f"{schema}, file string").json(directory)
    return read.schema(schema).json(f"{directory}/*.json").select("*", F.col("_metadata.file_name").alias("file"))


def scan_hour_json(spark: SparkSession, directory: str, named: bool = False) -> DataFrame:
    """Nested hour records, one document per series and month; the series is in the file name (see `_named_json`)."""
    docs = (
        _named_json(spark, directory, HOUR_DOCUMENT, named)
        .withColumn("_series", series_of_file(F.col("file"))).where("_series IS NOT NULL")
        .withColumns({"station": F.col("_series.station"), "parameter": F.col("_series.parameter")})
    )
    return hour_rows(docs, "station", "parameter", "file")


def stamp_text(period_from: Column, fallback: Column) -> Column:
    """Text of a {utc, local} stamp; the period start is preferred over the plain stamp."""
    return F.coalesce(period_from["utc"], period_from["local"], fallback["utc"], fallback["local"])


def explode_driver_arrays(docs: DataFrame, variables: list[str]) -> DataFrame:
    """One row per hour from `hourly` = struct of parallel arrays; absent variables are null.

    A document with an empty time list gives no rows. Other columns are kept.
    """
    fields = docs.schema["hourly"].dataType.names
    # A null array would empty the whole zip; an empty one is padded with nulls.
    empty = F.array().cast("array<double>")
    arrays = [F.col("hourly.time")] + [F.coalesce(F.col(f"hourly.{v}"), empty) for v in variables if v in fields]
    names = ["time"] + [v for v in variables if v in fields]
    zipped = docs.withColumn("_r", F.explode(F.arrays_zip(*[a.alias(n) for a, n in zip(arrays, names)])))
    out = {v: (F.col(f"_r.{v}").cast("double") if v in fields else F.lit(None).cast("double")) for v in variables}
    keep = [c for c in docs.columns if c != "hourly"]
    return zipped.select(*keep, to_local(F.col("_r.time"), naive="IST").alias("ts"), *[c.alias(v) for v, c in out.items()])


def pack_driver_arrays(rows: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """The reverse: rows to one array document per key (at most 24 hours per station-day)."""
    hour = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("time"), *variables)
    sorted_rows = F.sort_array(F.collect_list(hour))
    packed = rows.groupBy(*keys).agg(sorted_rows.alias("_r"))

    def field(name: str) -> Column:
        return F.transform("_r", lambda r: r[name]).alias(name)

    return packed.select(*keys, F.struct(*[field(n) for n in ["time", *variables]]).alias("hourly"))


def scan_driver_json(spark: SparkSession, directory: str, variables: list[str], named: bool = False) -> DataFrame:
    """Array-columnar driver documents of one folder; the station is the file-name stem (see `_named_json`).

    Variables that a document lacks are null; documents that are no JSON, or have no hours, give no rows.
    """
    hourly = ", ".join(["time: array<string>", *[f"`{v}`: array<double>" for v in variables]])
    docs = _named_json(spark, directory, f"hourly struct<{hourly}>, _corrupt string", named).where("_corrupt IS NULL")
    station = F.regexp_replace("file", r"[.]json$", "")
    return explode_driver_arrays(docs.select("hourly", station.alias("station")), variables)


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a manifest's issues, with the schema they were written with; a folder without manifest is unfinished."""
    manifest = spark.read.parquet(f"{path}/manifest")
    held = manifest.select("schema").first()
    if held is None:
        raise ValueError(f"no issues in {path}")
    docs = spark.read.schema(T.StructType.fromJson(json.loads(held["schema"]))).json(f"{path}/documents")
    return docs.join(broadcast_small(manifest.select("issue_time")), "issue_time", "left_semi")


def scan_fires(spark: SparkSession, directory: str) -> DataFrame:
    """All detection files of a folder; an empty folder gives an empty table."""
    try:
        return spark.read.schema(FIRE_SCHEMA).option("header", True).csv(f"{directory}/*.csv")
    except Exception as ex:
        if "PATH_NOT_FOUND" in str(ex):
            return spark.createDataFrame([], FIRE_SCHEMA)
        raise


def fires_bbox(fires: DataFrame, min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> DataFrame:
    """Detections inside a closed box; plain comparisons that reach the scan."""
    return fires.where(F.col("longitude").between(min_lon, max_lon) & F.col("latitude").between(min_lat, max_lat))


def join_drivers(air: DataFrame, met: DataFrame) -> DataFrame:
    """Air-composition and weather variables of the same station and hour."""
    return air.join(met, ["station", "ts"], "inner")


def drivers_for_seasons(drivers: DataFrame, stations: DataFrame, seasons: list[tuple[str, str]]) -> DataFrame:
    """Drivers of the registered stations inside any season (to 23:00 of its last day), once each."""
    inside = F.lit(False)
    for first, last in seasons:
        inside = inside | (
            (F.col("ts") >= F.lit(f"{first} 00:00:00").cast("timestamp_ntz"))
            & (F.col("ts") <= F.lit(f"{last} 23:00:00").cast("timestamp_ntz")))
    kept = drivers.where(inside).join(stations.select("station"), "station", "left_semi")
    values = [c for c in drivers.columns if c not in ("station", "ts")]
    return first_rows(kept, ["station", "ts"], values)


def archive_cycle(air: DataFrame, met: DataFrame, stations: DataFrame, issue_time: Column) -> DataFrame:
    """One forecast cycle in archive layout: lead hours counted from the issue time, lead >= 1."""
    lead = F.rint((micros("ts") - micros(issue_time)) / HOUR_US).cast("int")
    return (
        join_drivers(air, met)
        .join(stations.withColumnRenamed("name", "station_name"), "station", "inner")
        .withColumns({"issue_time": issue_time, "lead_h": lead})
        .where("lead_h >= 1")
        .withColumnRenamed("ts", "valid_time")
    )


def merge_archive(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union without repeated keys; the row that is already archived wins."""
    both = existing.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    order = ["_p", *[c for c in both.columns if c not in (*keys, "_p")]]
    return first_rows(both, keys, order).drop("_p")


def haversine_km(lat1: Column, lon1: Column, lat2: float, lon2: float) -> Column:
    half_lat = F.sin(F.radians(lat1 - lat2) / 2)
    half_lon = F.sin(F.radians(lon1 - lon2) / 2)
    a = half_lat * half_lat + math.cos(math.radians(lat2)) * F.cos(F.radians(lat1)) * half_lon * half_lon
    return 2 * 6371.0 * F.asin(F.sqrt(a))


def locations_within_radius(locations: DataFrame, lat: float, lon: float, km: float, name: str) -> DataFrame:
    """Locations inside the circle or with the text in their name; one scan, one row per id."""
    match = F.lower("name").contains(name.lower())
    near = haversine_km(F.col("latitude"), F.col("longitude"), lat, lon) <= km
    found = locations.withColumn("name_match", match).where(near | match)
    return first_rows(found, ["id"], [c for c in found.columns if c != "id"])


def location_documents(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Nested location documents from the given tables: a sensor per order status."""
    per = orders.groupBy(F.col("o_custkey").alias("id"), "o_orderstatus").agg(
        F.date_format(F.min("o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("a"),
        F.date_format(F.max("o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("b"),
    )
    kind = F.when(F.col("o_orderstatus") == "F", "PM25").when(F.col("o_orderstatus") == "O", "pm10").otherwise("no2")
    sensors = per.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(
        F.concat_ws("-", "id", "o_orderstatus").alias("id"),
        F.struct(kind.alias("name")).alias("parameter"),
        F.struct(F.col("a").alias("utc")).alias("datetimeFirst"),
        F.struct(F.col("b").alias("utc")).alias("datetimeLast"),
    ))).alias("sensors"))
    base = customers.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.struct(F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("name")).alias("provider"),
        F.struct(F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.lit("Board")).alias("name")).alias("owner"),
        F.struct((28 + F.col("c_custkey") % 97 * F.lit(0.01)).alias("latitude"), F.lit(77.3).alias("longitude")).alias("coordinates"),
    )
    return base.join(sensors, "id", "left")


def location_sensors(locations: DataFrame) -> DataFrame:
    """Flat location rows with their particle sensors and date bounds."""
    pm = F.filter(F.coalesce("sensors", F.array()), lambda s: F.lower(s["parameter"]["name"]).isin("pm25", "pm10"))
    pm = F.transform(pm, lambda s: F.struct(
        s["id"].alias("sensor_id"), F.lower(s["parameter"]["name"]).alias("parameter"),
        s["datetimeFirst"]["utc"].alias("datetime_first"), s["datetimeLast"]["utc"].alias("datetime_last")))
    return locations.withColumn("pm_sensors", pm).select(
        "id", F.coalesce("name", F.lit("Unknown")).alias("name"),
        join_labels(F.col("provider.name"), F.col("owner.name")).alias("provider_owner"),
        F.col("coordinates.latitude").alias("latitude"), F.col("coordinates.longitude").alias("longitude"),
        F.exists("pm_sensors", lambda s: s["parameter"] == "pm25").alias("has_pm25"),
        F.exists("pm_sensors", lambda s: s["parameter"] == "pm10").alias("has_pm10"),
        "pm_sensors",
    )
