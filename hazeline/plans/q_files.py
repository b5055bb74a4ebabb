"""Registered queries that go through files: tables are written in a raw layout and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeline.functions.numeric import safe_double
from hazeline.plans import adapters as A
from hazeline.plans import sqltext as S
from hazeline.plans.registry import plan
from hazeline.sources import readers as rd
from hazeline.sources import sinks as sk
from hazeline.streaming import archive as st

_C = F.col


@plan("safe_double", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1e0 WHEN event_id % 3 = 1 THEN value ELSE -1e0 END AS v FROM events""")
def safe_double_query(t):
    k = _C("event_id") % 3
    raw = F.when(k == 0, "NaN").when(k == 1, _C("value").cast("string")).otherwise("n/a")
    return A.table(t.spark, t.sf_dir, "events").select("event_id", safe_double(raw, -1.0).alias("v"))


@plan("scan_stations", S.sql("SELECT station, name, lat, lon FROM stations", "stations"))
def scan_stations(t):
    folder = sk.scratch_folder(t.spark, "stations")
    t.stations.select(_C("station").alias("id"), "name", "lat", "lon").write.option("header", True).csv(folder)
    return rd.scan_stations(t.spark, folder).withColumnRenamed("id", "station")


@plan("scan_fires", S.sql("SELECT latitude, longitude, CAST(acq_date AS VARCHAR) AS acq_date, acq_time, confidence, frp FROM fires", "fires"))
def scan_fires(t):
    """Detections written in the layout of the detection files, unknown columns empty."""
    folder = sk.scratch_folder(t.spark, "fires")
    known = t.fires.columns
    names = [f.split()[0] for f in rd.FIRE_SCHEMA.split(", ")]
    t.fires.select(*[_C(n) if n in known else F.lit(None).cast("string").alias(n) for n in names]).write.option("header", True).csv(folder)
    found = rd.scan_fires(t.spark, folder)
    return found.select("latitude", "longitude", "acq_date", _C("acq_time").cast("int").alias("acq_time"), "confidence", "frp")


#: Layouts of the station files: header per canonical column. Of the names that follow a token directly some count and some do not.
LAYOUTS = (
    {"pm25": "PM2.5 (ug/m3)", "pm10": "PM10 (ug/m3)", "no2": "NO2 (ug/m3)", "o3": "Ozone (ug/m3)"},
    {"o3": "Ozone-8h", "pm10": "PM10_raw", "no2": "NO2/ppb", "pm25": "PM2.5-avg"},
    {"pm25": "pm25", "o3": "OZONE", "no2": "NO2[ppb]", "pm10": "PM10"},
    {"pm25": " PM25x", "pm10": "PM10, raw", "no2": "NO2x", "o3": "S.O2"},
)


@plan("scan_obs_csv", S.sql("""SELECT station, ts, year(ts) AS year, pm25, pm10, CASE WHEN day(ts) % 4 <> 3 THEN no2 END AS no2,
 CASE WHEN day(ts) % 4 <> 3 THEN o3 END AS o3, CAST(NULL AS DOUBLE) AS so2 FROM obs""", "obs"))
def scan_obs_csv(t):
    """Observation files per station in several header layouts, cleaned and joined into one layout."""
    folder = sk.scratch_folder(t.spark, "station-files")
    name = F.concat(F.lit("Raw_Data_2024_site_1_"), _C("station"), F.lit("_hspcb_1Hr.csv"))
    for i, columns in enumerate(LAYOUTS):
        sk.write_station_files(t.obs.where(F.day("ts") % 4 == i), f"{folder}/layout={i}", columns, name)
    rows = rd.scan_obs_csv(t.spark, folder, named=True)
    return rows.select("station", "ts", F.year("ts").alias("year"), "pm25", "pm10", "no2", "o3", "so2")


def _month_file(station, parameter, ts):
    first = F.date_trunc("month", ts)
    stamps = [F.date_format(first, "yyyyMMdd"), F.date_format(F.add_months(first, 1), "yyyyMMdd")]
    return F.concat(F.concat_ws("_", station, parameter, *stamps), F.lit(".json"))


def _write_documents(docs, folder, damaged):
    """One document per `file`, in a folder of that name, and one that is no JSON."""
    docs.repartition("file").write.partitionBy("file").json(folder)
    docs.sparkSession.createDataFrame([("{ not json",)], "value string").write.text(f"{folder}/file={damaged}")


@plan("scan_hour_json", S.sql("""SELECT station, CASE parameter WHEN 'click' THEN 'pm25' ELSE 'pm10' END AS parameter, ts, value, coverage
 FROM hour_records WHERE parameter IN ('click', 'view')""", "hour_records"))
def scan_hour_json(t):
    """Hour records as one nested document per series and month; other series and damaged documents are passed over."""
    utc = F.date_format(F.timestamp_add("MINUTE", F.lit(-330), _C("ts")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rec = F.struct(
        _C("value").alias("value"),
        F.struct(F.struct(utc.alias("utc")).alias("datetimeFrom")).alias("period"),
        F.struct(_C("coverage").alias("percentComplete")).alias("coverage"))
    series = F.when(_C("parameter") == "click", "pm25").when(_C("parameter") == "view", "pm10").otherwise("temperature")
    docs = t.hour_records.groupBy(_month_file(_C("station"), series, _C("ts")).alias("file")).agg(F.collect_list(rec).alias("results"))
    folder = sk.scratch_folder(t.spark, "hour-documents")
    _write_documents(docs, folder, "st0_pm25_20230101_20230201.json")
    return rd.scan_hour_json(t.spark, folder, named=True).select("station", "parameter", "ts", "value", "coverage")


@plan("scan_driver_json", S.sql("""SELECT station, ts, pm2_5, CASE WHEN station <> 'st1' THEN ozone END AS ozone, CAST(NULL AS DOUBLE) AS dust
 FROM drivers""", "drivers"))
def scan_driver_json(t):
    """Driver hours as one array document per station; one lacks a variable, one is no JSON."""
    packed = rd.pack_driver_arrays(t.drivers, ["station"], ["pm2_5", "ozone"])
    whole = _C("hourly").alias("hourly")
    less = F.struct("hourly.time", "hourly.pm2_5", F.lit(None).cast("array<double>").alias("ozone")).alias("hourly")
    file = F.concat("station", F.lit(".json")).alias("file")
    one = _C("station") == "st1"
    docs = packed.where(~one).select(file, whole).unionByName(packed.where(one).select(file, less))
    folder = sk.scratch_folder(t.spark, "driver-documents")
    _write_documents(docs, folder, "damaged.json")
    return rd.scan_driver_json(t.spark, folder, ["pm2_5", "ozone", "dust"], named=True)


@plan("location_sensors", """WITH s AS (SELECT o_custkey AS id, o_custkey || '-' || o_orderstatus AS sensor_id,
  CASE o_orderstatus WHEN 'F' THEN 'pm25' WHEN 'O' THEN 'pm10' ELSE 'no2' END AS parameter,
  strftime(MIN(o_orderdate), '%Y-%m-%dT%H:%M:%SZ') AS datetime_first, strftime(MAX(o_orderdate), '%Y-%m-%dT%H:%M:%SZ') AS datetime_last
 FROM orders GROUP BY o_custkey, o_orderstatus),
c AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS p,
  CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'Board' END AS o, 28 + c_custkey % 97 * CAST(0.01 AS DOUBLE) AS latitude, CAST(77.3 AS DOUBLE) AS longitude FROM customer)
SELECT c.id, c.name, CASE WHEN p IS NOT NULL AND p <> o THEN p || ' / ' || o ELSE o END AS provider_owner, latitude, longitude,
 COALESCE(bool_or(parameter = 'pm25') OVER (PARTITION BY c.id), FALSE) AS has_pm25, COALESCE(bool_or(parameter = 'pm10') OVER (PARTITION BY c.id), FALSE) AS has_pm10,
 sensor_id, parameter, datetime_first, datetime_last
FROM c LEFT JOIN (SELECT * FROM s WHERE parameter <> 'no2') s ON s.id = c.id""")
def location_sensors(t):
    """Nested location documents built from customers and orders, flattened to one row per particle sensor."""
    docs = rd.location_documents(A.table(t.spark, t.sf_dir, "customer"), A.table(t.spark, t.sf_dir, "orders"))
    flat = rd.location_sensors(docs).withColumn("s", F.explode_outer("pm_sensors"))
    return flat.select("id", "name", "provider_owner", "latitude", "longitude", "has_pm25", "has_pm10",
                       "s.sensor_id", "s.parameter", "s.datetime_first", "s.datetime_last")


@plan("write_hourly", S.sql("SELECT CAST(year(ts) AS INTEGER) AS year, station, COUNT(*) AS n, COUNT(pm25) AS n25 FROM obs GROUP BY 1, 2", "obs"))
def write_hourly(t):
    folder = sk.scratch_folder(t.spark, "hourly")
    sk.write_hourly(t.obs, folder)
    return t.spark.read.parquet(folder).groupBy("year", "station").agg(F.count(F.lit(1)).alias("n"), F.count("pm25").alias("n25"))


_LANDED = "SELECT station, ts, TIMESTAMP '2024-01-10 06:00:00' AS issue_time, pm2_5 FROM drivers UNION ALL SELECT station, ts, TIMESTAMP '2024-01-20 06:00:00', pm2_5 FROM drivers"


@plan("stream_cycles", S.sql(f"SELECT station, issue_time, ts AS valid_time, CAST(date_diff('hour', issue_time, ts) AS INTEGER) AS lead_h, pm2_5 FROM ({_LANDED}) WHERE ts > issue_time", "drivers"))
def stream_cycles(t):
    """Two landed cycles archived by a file stream; a second run adds nothing."""
    base = sk.scratch_folder(t.spark, "cycles")
    for issue in ("2024-01-10 06:00:00", "2024-01-20 06:00:00"):
        t.drivers.withColumn("issue_time", F.lit(issue).cast("timestamp_ntz")).write.mode("append").parquet(f"{base}/landing")
    for _ in range(2):
        st.stream_cycles(t.spark, f"{base}/landing", f"{base}/archive", f"{base}/state")
    return t.spark.read.parquet(f"{base}/archive").select("station", "issue_time", "valid_time", "lead_h", "pm2_5")


@plan("stream_observations", S.sql("SELECT station, ts, pm25, CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'first' ELSE 'second' END AS source FROM obs", "obs"))
def stream_observations(t):
    """Two overlapping landings appended by a stream; the archived row wins."""
    base = sk.scratch_folder(t.spark, "readings")
    cut = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    first = t.obs.where(_C("ts") < cut).withColumn("source", F.lit("first"))
    second = t.obs.where(_C("ts") >= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).withColumn("source", F.lit("second"))
    for part in (first, second):
        part.select("station", "ts", "pm25", "pm10", "o3", "no2", "source").write.mode("append").parquet(f"{base}/landing")
        st.stream_observations(t.spark, f"{base}/landing", f"{base}/archive", f"{base}/state")
    return t.spark.read.parquet(f"{base}/archive").select("station", "ts", "pm25", "source")
