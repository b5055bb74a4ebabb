"""Registered queries of the ingest, cleaning and audit layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeline.constants import HOURLY_VALUES
from hazeline.functions import clock, numeric, text
from hazeline.operators import audit as au
from hazeline.operators import cleaning as cl
from hazeline.plans import adapters as A
from hazeline.plans import sqltext as S
from hazeline.plans.registry import query
from hazeline.sources import readers as rd

_C = F.col


@query("fires_bbox", S.sql("""SELECT CAST(acq_date AS VARCHAR) AS acq_date, acq_time, latitude, longitude FROM fires
WHERE longitude BETWEEN 73.8 AND 77.0 AND latitude BETWEEN 29.5 AND 32.6""", "fires"))
def fires_bbox(spark, sf):
    return rd.fires_bbox(A.fires(spark, sf), 73.8, 29.5, 77.0, 32.6).select(
        _C("acq_date").cast("string").alias("acq_date"), "acq_time", "latitude", "longitude")


@query("nan_to_null", S.sql("""SELECT group_id, COUNT(*) AS n, COUNT(v) AS n_valid, MAX(v) AS v_max FROM (SELECT group_id,
  CASE WHEN isnan(x) OR isinf(x) THEN NULL ELSE x END AS v FROM (SELECT group_id,
  CASE WHEN pm25 > 390 THEN CAST('nan' AS DOUBLE) WHEN pm25 < 9 THEN CAST('-infinity' AS DOUBLE) ELSE pm25 END AS x FROM joint_samples)) GROUP BY 1""", "joint_samples"))
def nan_to_null(spark, sf):
    d = A.joint_samples(spark, sf).withColumn("v", F.when(_C("pm25") > 390, float("nan")).when(
        _C("pm25") < 9, float("-inf")).otherwise(_C("pm25")))
    return numeric.normalise_missing(d).groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("v").alias("n_valid"), F.max("v").alias("v_max"))


@query("slugify", """SELECT c_custkey, lower(regexp_replace(regexp_replace(c_mktsegment || ', ' || c_name || ' - Site', '[^a-zA-Z0-9]+', '_', 'g'),
 '^_+|_+$', '', 'g')) AS slug FROM customer""")
def slugify(spark, sf):
    c = A.table(spark, sf, "customer")
    return c.select("c_custkey", text.slugify(F.concat(_C("c_mktsegment"), F.lit(", "), _C("c_name"), F.lit(" - Site"))).alias("slug"))


@query("station_from_filename", "SELECT c_custkey, 'sector_' || lower(c_mktsegment) AS station FROM customer")
def station_from_filename(spark, sf):
    c = A.table(spark, sf, "customer")
    k = _C("c_custkey") % 4
    name = F.concat(
        F.lit("Raw_Data_2021_site_"), _C("c_custkey").cast("string"), F.lit("_sector_"), F.lower("c_mktsegment"),
        F.when(k == 0, "_hspcb_1Hr.csv").when(k == 1, "_dpcc_1Hr.csv").when(k == 2, "_hspcb_15Min.csv").otherwise(".csv"))
    return c.select("c_custkey", text.station_from_filename(name).alias("station"))


@query("to_ist", """SELECT event_id, date_trunc('second', ts) + INTERVAL 330 MINUTE AS from_utc, date_trunc('second', ts) + INTERVAL 330 MINUTE AS from_naive,
 date_trunc('second', ts) AS from_local FROM events""")
def to_ist(spark, sf):
    e = A.table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("t"))
    return e.select(
        "event_id",
        clock.to_local(F.concat("t", F.lit("Z"))).alias("from_utc"),
        clock.to_local(_C("t")).alias("from_naive"),
        clock.to_local(F.concat("t", F.lit("+05:30"))).alias("from_local"),
    )


_RAWTEXT = "CASE event_id % 7 WHEN 0 THEN 'NA' WHEN 1 THEN '-' WHEN 2 THEN '1d' WHEN 3 THEN ' ' || CAST(value AS VARCHAR) ELSE CAST(value AS VARCHAR) END"


@query("coerce_numeric", f"""SELECT event_id, CASE WHEN event_id % 7 IN (0, 1, 2) THEN NULL ELSE value END AS pm25, CAST(NULL AS DOUBLE) AS pm10 FROM events""")
def coerce_numeric(spark, sf):
    k = _C("event_id") % 7
    v = _C("value").cast("string")
    raw = A.table(spark, sf, "events").select("event_id", F.when(k == 0, "NA").when(k == 1, "-").when(k == 2, "1d").when(
        k == 3, F.concat(F.lit(" "), v)).otherwise(v).alias("pm25"))
    return cl.coerce_numeric(raw, ["pm25", "pm10"])


@query("flag_capped", S.sql("""SELECT station, ts, pm10, COALESCE(pm10 = 1000, FALSE) AS pm10_capped FROM
 (SELECT station, ts, CASE WHEN pm10 > 700 THEN 1000e0 ELSE pm10 END AS pm10 FROM obs)""", "obs"))
def flag_capped(spark, sf):
    o = A.obs(spark, sf).select("station", "ts", F.when(_C("pm10") > 700, 1000.0).otherwise(_C("pm10")).alias("pm10"))
    return cl.flag_capped(o)


_HR = "station, parameter, ts, value, coverage, file_order"


@query("align_minute00", S.sql(f"SELECT {_HR} FROM hour_records WHERE minute(ts) = 0", "hour_records"))
def align_minute00(spark, sf):
    return cl.align_minute00(A.hour_records(spark, sf))


@query("coverage_filter", S.sql(f"SELECT station, parameter, ts, value, cov AS coverage FROM (SELECT *, CASE WHEN file_order % 11 = 0 THEN NULL ELSE coverage END AS cov FROM hour_records) WHERE cov IS NULL OR cov >= 75", "hour_records"))
def coverage_filter(spark, sf):
    h = A.hour_records(spark, sf).withColumn("coverage", F.when(_C("file_order") % 11 == 0, None).otherwise(_C("coverage")))
    return cl.coverage_filter(h).drop("file_order")


@query("drop_exact_dups", S.sql("SELECT DISTINCT station, parameter, ts, round_even(value / 10, 0)::DOUBLE AS value FROM hour_records", "hour_records"))
def drop_exact_dups(spark, sf):
    h = A.hour_records(spark, sf).withColumn("value", F.rint(_C("value") / 10))
    return cl.drop_exact_dups(h, ["station", "parameter", "ts", "value"])


S.view("clean_hours", """SELECT DISTINCT station, parameter, ts, value FROM hour_records
WHERE value IS NOT NULL AND ts IS NOT NULL AND minute(ts) = 0 AND (coverage IS NULL OR coverage >= 75)""", "hour_records")


@query("hour_records_clean", S.sql("SELECT * FROM clean_hours", "clean_hours"))
def hour_records_clean(spark, sf):
    return cl.hour_records_clean(A.hour_records(spark, sf), ["station", "parameter"])


S.view("hourly_means", f"""SELECT station, parameter, ts, n_samples, value FROM (
 SELECT *, MAX(n_samples) OVER (PARTITION BY station, parameter) AS finest FROM (
 SELECT station, parameter, date_trunc('hour', ts) AS ts, COUNT(value) AS n_samples, {S.eavg('value')} AS value
 FROM (SELECT DISTINCT station, parameter, ts, value FROM hour_records) GROUP BY 1, 2, 3))
WHERE n_samples >= CASE WHEN finest >= 4 THEN 3 ELSE 1 END""", "hour_records")


@query("subhourly_to_hourly", S.sql("SELECT * FROM hourly_means", "hourly_means"))
def subhourly_to_hourly(spark, sf):
    return cl.subhourly_to_hourly(A.hour_records(spark, sf), ["station", "parameter"])


@query("long_to_wide", S.sql("""SELECT station, ts,
 arg_max(value, file_order) FILTER (WHERE parameter = 'click') AS click,
 arg_max(value, file_order) FILTER (WHERE parameter = 'view') AS view
FROM hour_records WHERE parameter IN ('click', 'view') GROUP BY 1, 2""", "hour_records"))
def long_to_wide(spark, sf):
    return cl.long_to_wide(A.hour_records(spark, sf), ["station", "ts"], ["click", "view"], "file_order")


@query("pm_outer_merge", S.sql("""SELECT COALESCE(a.station, b.station) AS station, COALESCE(a.ts, b.ts) AS ts, a.value AS pm25, b.value AS pm10
FROM (SELECT * FROM hourly_means WHERE parameter = 'click') a
FULL JOIN (SELECT * FROM hourly_means WHERE parameter = 'view') b ON a.station = b.station AND a.ts = b.ts""", "hourly_means"))
def pm_outer_merge(spark, sf):
    h = cl.subhourly_to_hourly(A.hour_records(spark, sf), ["station", "parameter"])
    a = h.where("parameter = 'click'").select("station", "ts", _C("value").alias("pm25"))
    b = h.where("parameter = 'view'").select("station", "ts", _C("value").alias("pm10"))
    return cl.pm_outer_merge(a, b, ["station", "ts"])


@query("conform_layout", S.sql("SELECT ts, station, 'network' AS source, " + ", ".join(
    f"CAST({n if n in ('pm25', 'pm10', 'no2', 'o3') else 'NULL'} AS DOUBLE) AS \"{n}\"" for n in HOURLY_VALUES)
    + ", COALESCE(pm10 = 1000, FALSE) AS pm10_capped FROM obs", "obs"))
def conform_layout(spark, sf):
    return cl.conform_layout(A.obs(spark, sf), "network")


@query("merge_sources", S.sql("""SELECT COALESCE(o.station, d.station) AS station, COALESCE(o.ts, d.ts) AS ts, o.pm25, o.pm10,
 COALESCE(o.no2, d.nitrogen_dioxide) AS no2, COALESCE(o.o3, d.ozone) AS o3
FROM obs o FULL JOIN drivers d ON o.station = d.station AND o.ts = d.ts""", "obs", "drivers"))
def merge_sources(spark, sf):
    second = A.drivers(spark, sf).select("station", "ts", _C("nitrogen_dioxide").alias("no2"), _C("ozone").alias("o3"))
    return cl.merge_sources(A.obs(spark, sf), second, ["station", "ts"], ["no2", "o3"])


@query("dedupe_first", S.sql("""SELECT station, parameter, ts, value, coverage, file_order FROM (
 SELECT *, row_number() OVER (PARTITION BY station, ts ORDER BY file_order) AS rn FROM hour_records) WHERE rn = 1""", "hour_records"))
def dedupe_first(spark, sf):
    return cl.dedupe_first(A.hour_records(spark, sf), ["station", "ts"], ["file_order"])


_DUPS = """both_obs AS (SELECT station, ts, pm25 FROM obs UNION ALL SELECT 'copy_' || station, ts + INTERVAL 1 DAY, pm25 FROM obs WHERE ts < TIMESTAMP '2024-01-30'
   UNION ALL SELECT 'same_' || station, ts, pm25 FROM obs),
n AS (SELECT station, year(ts) AS year, row_number() OVER (PARTITION BY station, year(ts) ORDER BY ts) AS rn, pm25 AS v,
  COUNT(*) OVER (PARTITION BY station, year(ts)) AS n_rows FROM both_obs),
p AS (SELECT a.year, a.station, b.station AS same_as, a.n_rows FROM n a JOIN n b ON a.year = b.year AND a.rn = b.rn AND a.n_rows = b.n_rows
  AND b.station < a.station AND a.v IS NOT DISTINCT FROM b.v GROUP BY 1, 2, 3, 4 HAVING COUNT(*) = a.n_rows)"""


@query("dup_series_pairs", S.sql(f"WITH {_DUPS} SELECT year, station, MIN(same_as) AS same_as, n_rows FROM p GROUP BY 1, 2, 4", "obs"))
def dup_series_pairs(spark, sf):
    o = A.obs(spark, sf).select("station", "ts", "pm25")
    shifted = o.where(_C("ts") < F.lit("2024-01-30").cast("timestamp_ntz")).select(
        F.concat(F.lit("copy_"), "station").alias("station"), clock.plus_hours("ts", 24).alias("ts"), "pm25")
    same = o.select(F.concat(F.lit("same_"), "station").alias("station"), "ts", "pm25")
    return cl.duplicate_series(o.unionByName(shifted).unionByName(same))


_GAPS = """g AS (SELECT station, ts, copies, lag(ts) OVER (PARTITION BY station ORDER BY ts) AS prev FROM (
  SELECT station, ts, COUNT(*) AS copies FROM hour_records GROUP BY 1, 2))"""


@query("continuity_audit", S.sql(f"WITH {_GAPS} SELECT station, CAST(SUM(copies - 1) AS BIGINT) AS duplicates, COUNT(*) FILTER (WHERE ts - prev > INTERVAL 1 HOUR) AS gaps FROM g GROUP BY 1", "hour_records"))
def continuity_audit(spark, sf):
    return au.continuity_audit(A.hour_records(spark, sf))


@query("gap_rows", S.sql("""SELECT station, ts, (epoch_us(ts) - epoch_us(prev)) / 3600000000 AS gap_hours FROM (
 SELECT station, ts, lag(ts) OVER (PARTITION BY station ORDER BY ts) AS prev FROM obs) WHERE ts - prev > INTERVAL 1 HOUR""", "obs"))
def gap_rows(spark, sf):
    return au.gap_rows(A.obs(spark, sf))


_REP = """r AS (SELECT station, ts, pm25, CASE WHEN pm10 > 700 THEN 1000e0 ELSE pm10 END AS pm10 FROM obs),
t AS (SELECT *, lag(ts) OVER (PARTITION BY station ORDER BY ts) AS prev FROM r)"""


@query("station_report", S.sql(f"""WITH {_REP} SELECT station, MIN(ts) AS first_ts, MAX(ts) AS last_ts, COUNT(*) AS n_rows,
 COUNT(*) FILTER (WHERE pm25 IS NULL) AS pm25_missing, COUNT(*) FILTER (WHERE pm10 IS NULL) AS pm10_missing,
 COUNT(*) FILTER (WHERE pm10 = 1000) AS pm10_capped_hours, CAST(0 AS BIGINT) AS duplicates,
 COUNT(*) FILTER (WHERE ts - prev > INTERVAL 1 HOUR) AS gaps,
 {S.rnd("COUNT(*) FILTER (WHERE pm25 IS NULL) / COUNT(*) * 100", 2)} AS pm25_missing_pct,
 {S.rnd("COUNT(*) FILTER (WHERE pm10 IS NULL) / COUNT(*) * 100", 2)} AS pm10_missing_pct
FROM t GROUP BY ROLLUP(station)""", "obs"))
def station_report(spark, sf):
    o = A.obs(spark, sf).withColumn("pm10", F.when(_C("pm10") > 700, 1000.0).otherwise(_C("pm10")))
    return au.station_report(o)


@query("raw_inspection", S.sql("""WITH u AS (SELECT station, parameter, strftime(ts, '%Y-%m') AS month, ts, COUNT(*) AS copies,
  arg_min(value, file_order) AS value, MIN(file_order) AS first FROM hour_records GROUP BY 1, 2, 3, 4),
g AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY station, parameter, month ORDER BY ts))) / 60000000 AS gap FROM u)
SELECT station, parameter, month, CAST(SUM(copies) AS BIGINT) AS n_records, CAST(SUM(copies - 1) AS BIGINT) AS duplicates,
 quantile_cont(gap, 0.5) AS median_gap_min, arg_min(value, first) AS example_value FROM g GROUP BY 1, 2, 3""", "hour_records"))
def raw_inspection(spark, sf):
    return au.raw_inspection(A.hour_records(spark, sf), ["station", "parameter"])


@query("monthly_coverage", S.sql(f"""WITH m AS (SELECT DISTINCT station FROM obs),
spine AS (SELECT station, CAST(unnest(generate_series(DATE '2023-10-01', DATE '2024-02-01', INTERVAL 1 MONTH)) AS DATE) AS month_start FROM m),
d AS (SELECT station, CAST(date_trunc('month', ts) AS DATE) AS month_start, {S.REPORTING_DATE.format(ts='ts')} AS rep, COUNT(pm25) AS h25, COUNT(pm10) AS h10 FROM obs GROUP BY 1, 2, 3),
a AS (SELECT station, month_start, SUM(h25) AS h25, SUM(h10) AS h10, COUNT(*) FILTER (WHERE h25 >= 16) AS days FROM d GROUP BY 1, 2),
j AS (SELECT s.station, s.month_start, day(last_day(s.month_start)) AS dim, COALESCE(h25, 0) AS h25, COALESCE(h10, 0) AS h10, COALESCE(days, 0) AS days
  FROM spine s LEFT JOIN a ON a.station = s.station AND a.month_start = s.month_start)
SELECT station, strftime(month_start, '%Y-%m') AS month, CAST(dim * 24 AS INTEGER) AS hours_possible, CAST(h25 AS BIGINT) AS valid_pm25, CAST(h10 AS BIGINT) AS valid_pm10,
 {S.rnd('h25 / (dim * 24) * 100', 1)} AS pm25_pct, {S.rnd('h10 / (dim * 24) * 100', 1)} AS pm10_pct, CAST(days AS BIGINT) AS passing_days, CAST(dim AS INTEGER) AS days_in_month FROM j""", "obs"))
def monthly_coverage(spark, sf):
    return au.monthly_coverage(A.obs(spark, sf), "2023-10-01", "2024-02-01")


_WLAB = "CASE WHEN month(date) >= 10 THEN CAST(year(date) AS VARCHAR) || '-' || CAST(year(date) + 1 AS VARCHAR) WHEN month(date) <= 2 THEN CAST(year(date) - 1 AS VARCHAR) || '-' || CAST(year(date) AS VARCHAR) ELSE 'Other' END"


@query("winter_means", S.sql(f"""SELECT winter, station, COUNT(aqi) AS valid_hours, {S.rnd(S.eavg('aqi'), 2)} AS mean_value,
 {S.rnd('stddev_samp(aqi)', 2)} AS std_value FROM (SELECT *, {_WLAB} AS winter FROM daily_long) WHERE winter <> 'Other' AND aqi IS NOT NULL GROUP BY 1, 2""", "daily_long"))
def winter_means(spark, sf):
    return au.winter_means(A.daily_long(spark, sf), ts="date", value="aqi")


_WINTERS = [("2022-23", "2022-10-01", "2023-02-28"), ("2023-24", "2023-10-01", "2024-02-29")]


def _audit_sql(winters):
    w = ", ".join(f"('{n}', TIMESTAMP '{a} 00:00:00', TIMESTAMP '{b} 23:00:00')" for n, a, b in winters)
    return S.sql(f"""WITH w AS (SELECT * FROM (VALUES {w}) t(winter, t0, t1)),
l AS (UNPIVOT (SELECT station, ts, pm25, pm10, o3, no2 FROM obs) ON pm25, pm10, o3, no2 INTO NAME pollutant VALUE v),
c AS (SELECT s.station, w.winter, p.pollutant, CAST(date_diff('hour', w.t0, w.t1) + 1 AS BIGINT) AS calendar_hours,
  (SELECT COUNT(*) FROM l WHERE l.station = s.station AND l.pollutant = p.pollutant AND l.ts >= w.t0 AND l.ts <= w.t1) AS valid_hours
  FROM (SELECT DISTINCT station FROM stations) s, w, (VALUES ('pm25'), ('pm10'), ('o3'), ('no2')) p(pollutant))
SELECT station, winter, calendar_hours, pollutant, valid_hours, calendar_hours - valid_hours AS missing_hours,
 {S.rnd('valid_hours / calendar_hours * 100', 1)} AS valid_pct, {S.rnd('(calendar_hours - valid_hours) / calendar_hours * 100', 1)} AS missing_pct FROM c""", "obs", "stations")


@query("winter_audit", _audit_sql(_WINTERS))
def winter_audit(spark, sf):
    return au.winter_audit(A.obs(spark, sf), A.stations(spark, sf), _WINTERS)


_HELD = [("held-out", "2024-01-21", "2024-01-30")]


@query("heldout_audit", _audit_sql(_HELD))
def heldout_audit(spark, sf):
    return au.winter_audit(A.obs(spark, sf), A.stations(spark, sf), _HELD)


@query("season_windows", S.sql("""WITH y AS (SELECT DISTINCT CAST(CASE WHEN month(date) >= 10 THEN year(date) ELSE year(date) - 1 END AS INTEGER) AS start_year
   FROM daily_long WHERE month(date) IN (10, 11, 12, 1, 2)),
w AS (SELECT start_year, CAST(unnest(generate_series(make_date(start_year, 10, 1), make_date(start_year + 1, 2, 1), INTERVAL 1 MONTH)) AS DATE) AS f FROM y)
SELECT CAST(start_year AS VARCHAR) || '-' || CAST(start_year + 1 AS VARCHAR) AS season, CAST(f AS VARCHAR) AS window_from,
 CAST(CAST(f + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS window_to, CAST(day(last_day(f)) AS INTEGER) AS n_days FROM w""", "daily_long"))
def season_windows(spark, sf):
    d = A.daily_long(spark, sf).where(F.month("date").isin(10, 11, 12, 1, 2))
    seasons = d.select(F.when(F.month("date") >= 10, F.year("date")).otherwise(F.year("date") - 1).alias("start_year")).distinct()
    w = au.season_windows(seasons)
    return w.withColumns({c: _C(c).cast("string") for c in ("window_from", "window_to")})


@query("date_chunks", S.sql("""WITH y AS (SELECT DISTINCT CAST(year(acq_date) AS INTEGER) AS year FROM fires),
w AS (SELECT year, CAST(unnest(generate_series(make_date(year, 10, 1), make_date(year, 11, 30), INTERVAL 5 DAY)) AS DATE) AS f FROM y)
SELECT year, CAST(f AS VARCHAR) AS window_from, CAST(least(5, date_diff('day', f, make_date(year, 11, 30)) + 1) AS INTEGER) AS n_days FROM w""", "fires"))
def date_chunks(spark, sf):
    years = A.fires(spark, sf).select(F.year("acq_date").alias("year")).distinct()
    return au.date_chunks(years).withColumn("window_from", _C("window_from").cast("string"))


@query("window_overlap", """WITH s AS (SELECT o_custkey AS sensor_id, CAST(MIN(o_orderdate) AS DATE) AS first_date,
  CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE CAST(MAX(o_orderdate) AS DATE) END AS last_date FROM orders GROUP BY o_custkey),
w AS (SELECT CAST(make_date(y, 10, 1) + to_months(CAST(k AS INTEGER)) AS DATE) AS f FROM range(1995, 2002) t(y), range(0, 5) u(k)),
j AS (SELECT sensor_id, f, CAST(f + INTERVAL 1 MONTH AS DATE) AS t, COALESCE(f + INTERVAL 1 MONTH <= first_date, FALSE) AS early, COALESCE(f >= last_date, FALSE) AS late FROM s, w)
SELECT sensor_id, CAST(f AS VARCHAR) AS window_from, CAST(t AS VARCHAR) AS window_to, early OR late AS skip,
 CASE WHEN early THEN 'window ends before the sensor''s first reading' WHEN late THEN 'window starts after the sensor''s last reading' END AS reason FROM j""")
def window_overlap(spark, sf):
    o = A.table(spark, sf, "orders")
    last = F.when(_C("sensor_id") % 5 == 0, None).otherwise(_C("last_date"))
    sensors = o.groupBy(_C("o_custkey").alias("sensor_id")).agg(
        F.to_date(F.min("o_orderdate")).alias("first_date"), F.to_date(F.max("o_orderdate")).alias("last_date")
    ).withColumn("last_date", last)
    w = au.window_overlap(sensors, 1995, 2001).drop("first_date", "last_date")
    return w.withColumns({c: _C(c).cast("string") for c in ("window_from", "window_to")})


@query("season_filter", S.sql("""SELECT COUNT(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20') AS half_open,
 COUNT(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20') AS closed, station FROM obs GROUP BY station""", "obs"))
def season_filter(spark, sf):
    o = A.obs(spark, sf).select("station", "ts")
    a, b = F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz")
    whole = cl.season_filter(o, "ts", a, b)
    half = _C("ts") < b
    return whole.groupBy("station").agg(F.count_if(half).alias("half_open"), F.count(F.lit(1)).alias("closed"))


@query("explode_driver_arrays", S.sql("SELECT station, ts, pm2_5, pm10, ozone, CAST(NULL AS DOUBLE) AS dust FROM drivers", "drivers"))
def explode_driver_arrays(spark, sf):
    """Driver rows packed into one array document per station-day, then exploded again."""
    d = A.drivers(spark, sf)
    packed = rd.pack_driver_arrays(d.withColumn("day", F.to_date("ts")), ["station", "day"], ["pm2_5", "pm10", "ozone"])
    return rd.explode_driver_arrays(packed.drop("day"), ["pm2_5", "pm10", "ozone", "dust"])


@query("join_drivers", S.sql("""SELECT station, ts, pm2_5, pm10, ozone, nitrogen_dioxide, temperature_2m, relative_humidity_2m, wind_speed_10m,
 wind_direction_10m, boundary_layer_height, surface_pressure FROM drivers WHERE hour(ts) <> 5""", "drivers"))
def join_drivers(spark, sf):
    d = A.drivers(spark, sf)
    air = d.select("station", "ts", "pm2_5", "pm10", "ozone", "nitrogen_dioxide").where(F.hour("ts") != 5)
    return rd.join_drivers(air, d.drop("pm2_5", "pm10", "ozone", "nitrogen_dioxide"))


@query("drivers_for_seasons", S.sql("""SELECT station, ts, pm2_5 FROM drivers WHERE (ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts <= TIMESTAMP '2024-01-12 23:00:00')
 OR (ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-15 23:00:00')""", "drivers"))
def drivers_for_seasons(spark, sf):
    return rd.drivers_for_seasons(A.drivers(spark, sf), A.stations(spark, sf),
                                  [("2024-01-03", "2024-01-12"), ("2024-01-10", "2024-01-15")]).select("station", "ts", "pm2_5")


_ISSUE = "2024-01-15 06:20:00"


@query("archive_cycle", S.sql(f"""SELECT TIMESTAMP '{_ISSUE}' AS issue_time, d.station, s.name AS station_name, d.ts AS valid_time,
 CAST(round_even((epoch_us(d.ts) - epoch_us(TIMESTAMP '{_ISSUE}')) / 3600000000, 0) AS INTEGER) AS lead_h, d.pm2_5, d.temperature_2m
FROM drivers d JOIN stations s ON s.station = d.station
WHERE round_even((epoch_us(d.ts) - epoch_us(TIMESTAMP '{_ISSUE}')) / 3600000000, 0) >= 1""", "drivers", "stations"))
def archive_cycle(spark, sf):
    d = A.drivers(spark, sf)
    air = d.select("station", "ts", "pm2_5", "pm10", "ozone", "nitrogen_dioxide")
    met = d.drop("pm2_5", "pm10", "ozone", "nitrogen_dioxide")
    cycle = rd.archive_cycle(air, met, A.stations(spark, sf), F.lit(_ISSUE).cast("timestamp_ntz"))
    return cycle.select("issue_time", "station", "station_name", "valid_time", "lead_h", "pm2_5", "temperature_2m")


@query("archive_upsert", S.sql("""SELECT station, ts, pm25, source FROM (SELECT *, row_number() OVER (PARTITION BY station, ts ORDER BY pr) AS rn FROM (
 SELECT station, ts, pm25, 'old' AS source, 0 AS pr FROM obs WHERE ts < TIMESTAMP '2024-01-20'
 UNION ALL SELECT station, ts, pm25 + 1, 'new', 1 FROM obs WHERE ts >= TIMESTAMP '2024-01-15')) WHERE rn = 1""", "obs"))
def archive_upsert(spark, sf):
    o = A.obs(spark, sf).select("station", "ts", "pm25")
    old = o.where(_C("ts") < F.lit("2024-01-20").cast("timestamp_ntz")).withColumn("source", F.lit("old"))
    new = o.where(_C("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")).select(
        "station", "ts", (_C("pm25") + 1).alias("pm25"), F.lit("new").alias("source"))
    return rd.merge_archive(old, new, ["station", "ts"])


@query("latest_obs_pivot", S.sql("""SELECT station, MAX(ts) AS ts,
 arg_max(value, file_order) FILTER (WHERE parameter = 'click') AS pm25, arg_max(value, file_order) FILTER (WHERE parameter = 'view') AS pm10,
 arg_max(value, file_order) FILTER (WHERE parameter = 'error') AS o3, arg_max(value, file_order) FILTER (WHERE parameter = 'purchase') AS no2
FROM hour_records GROUP BY 1""", "hour_records"))
def latest_obs_pivot(spark, sf):
    p = _C("parameter")
    h = A.hour_records(spark, sf).select("station", "ts", "value", _C("file_order").alias("position"), F.when(p == "click", "PM2.5").when(
        p == "view", "pm10").when(p == "error", "ozone").when(p == "purchase", "nitrogen_dioxide").otherwise("co").alias("parameter"))
    return cl.latest_readings(h)


@query("locations_within_radius", S.sql("""SELECT id, name, name_match FROM (SELECT id, name, lower(name) LIKE '%machinery%' AS name_match,
 2 * 6371e0 * asin(sqrt(pow(sin(radians(latitude - 28.4) / 2), 2) + cos(radians(28.4)) * cos(radians(latitude)) * pow(sin(radians(longitude - 77.3) / 2), 2))) AS km
 FROM locations) WHERE km <= 25 OR name_match""", "locations"))
def locations_within_radius(spark, sf):
    return rd.locations_within_radius(A.locations(spark, sf), 28.4, 77.3, 25.0, "machinery").select("id", "name", "name_match")
