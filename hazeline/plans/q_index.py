"""Registered queries of the index engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeline.constants import CATEGORIES, CONC_BANDS, INDEX_NAMES
from hazeline.functions import index as ix
from hazeline.operators import daily as dy
from hazeline.plans import adapters as A
from hazeline.plans import sqltext as S
from hazeline.plans.registry import query
from hazeline.sources import readers as rd
from hazeline.sources import sinks as sk

_C = F.col


@query("scan_breakpoints", S.sql("""
SELECT b.pollutant, b.category, b.averaging_hours, b.conc_low, b.conc_high, b.index_low, b.index_high,
  COUNT(o.v) AS n_hours
FROM breakpoints b LEFT JOIN (
  SELECT 'PM2.5' AS pollutant, pm25 AS v FROM obs UNION ALL SELECT 'PM10', pm10 FROM obs
  UNION ALL SELECT 'NO2', no2 FROM obs UNION ALL SELECT 'O3', o3 FROM obs) o
ON o.pollutant = b.pollutant AND o.v >= b.conc_low AND o.v <= b.conc_high
GROUP BY ALL""", "breakpoints", "obs"))
def scan_breakpoints(spark, sf):
    """The breakpoint file, written and read back, with the observed hours inside each band."""
    folder = sk.scratch_folder(spark, "breakpoints")
    A.breakpoints(spark).write.option("header", True).csv(folder)
    bp = rd.scan_breakpoints(spark, folder).withColumn("averaging_hours", F.col("averaging_hours").cast("int"))
    long = dy.unpivot(A.obs(spark, sf).select("pm25", "pm10", "no2", "o3"), [], ["pm25", "pm10", "no2", "o3"])
    name = F.create_map(*[F.lit(x) for k in INDEX_NAMES.items() for x in k])
    long = long.select(F.element_at(name, F.col("pollutant")).alias("pollutant"), "value").where("value IS NOT NULL")
    hours = dy.band_counts(long)
    return bp.join(hours, ["pollutant", "category"], "left").withColumn("n_hours", F.coalesce("n_hours", F.lit(0).cast("long")))


@query("category_thresholds", S.sql("""
SELECT t.event, t.threshold, COUNT(*) FILTER (WHERE d.aqi >= t.threshold) AS n_days
FROM daily_long d, (SELECT CASE WHEN category = 'Severe' THEN 'Severe' ELSE 'Very Poor or worse' END AS event,
  MIN(index_low) AS threshold FROM breakpoints WHERE category IN ('Severe', 'Very Poor') GROUP BY 1) t
GROUP BY 1, 2""", "breakpoints", "daily_long"))
def category_thresholds(spark, sf):
    """Alert thresholds with the station-days that reach them."""
    daily = A.daily_long(spark, sf)
    hits = dy.threshold_hits(daily)
    return ix.category_thresholds(A.breakpoints(spark)).join(hits, "event")


_SUBS = [("pm25", "PM2.5"), ("pm10", "PM10"), ("no2", "NO2"), ("o3", "O3")]


@query("sub_index", S.sql("SELECT station, ts, " + ", ".join(
    f"{S.sub_index(p, c)} AS si_{c}, {S.sub_index(p, c, 'continuous')} AS sc_{c}" for c, p in _SUBS) + " FROM obs", "obs"))
def sub_index(spark, sf):
    return A.obs(spark, sf).select(
        "station", "ts",
        *[ix.sub_index(p, c).alias(f"si_{c}") for c, p in _SUBS],
        *[ix.sub_index(p, c, "continuous").alias(f"sc_{c}") for c, p in _SUBS],
    )


@query("sub_index_all_pollutants", S.sql(
    "SELECT profile, height_m, " + ", ".join(f"{S.sub_index(p, f'(temp_c * {m})')} AS si_{i}"
    for i, (p, m) in enumerate(zip(CONC_BANDS, (9, 8, 7, 45, 1, 20, 50)))) + " FROM soundings", "soundings"))
def sub_index_all_pollutants(spark, sf):
    """All seven band tables, the pollutant name taken from a column."""
    scaled = {f"c{i}": _C("temp_c") * m for i, m in enumerate((9, 8, 7, 45, 1, 20, 50))}
    df = A.soundings(spark, sf).withColumns(scaled)
    return df.select("profile", "height_m", *[
        ix.sub_index_any(f"' {p.lower()} '", f"c{i}").alias(f"si_{i}")
        for i, p in enumerate(CONC_BANDS)
    ])


@query("aqi_max", S.sql("SELECT station, ts, greatest(" + ", ".join(
    S.sub_index(p, c) for c, p in _SUBS) + ") AS aqi FROM obs", "obs"))
def aqi_max(spark, sf):
    return A.obs(spark, sf).select("station", "ts", ix.aqi_max(*[ix.sub_index(p, c) for c, p in _SUBS]).alias("aqi"))


@query("aqi_category", S.sql(f"""SELECT station, date, aqi, {S.category('aqi')} AS category,
  {S.category('aqi', 'continuous')} AS category_continuous FROM
  (SELECT station, CAST(date AS VARCHAR) AS date, aqi FROM daily_long)""", "daily_long"))
def aqi_category(spark, sf):
    return A.daily_long(spark, sf).select(
        "station", _C("date").cast("string").alias("date"), "aqi",
        ix.aqi_category("aqi").alias("category"),
        ix.aqi_category("aqi", "continuous").alias("category_continuous"),
    )


@query("pm_to_aqi", S.sql(f"""SELECT station, ts, aqi, {S.category('aqi')} AS category
FROM (SELECT station, ts, {S.pm_index('pm25', 'pm10')} AS aqi FROM obs)""", "obs"))
def pm_to_aqi(spark, sf):
    return ix.pm_to_aqi(A.obs(spark, sf)).select("station", "ts", "aqi", "category")


@query("category_counts_hourly", S.sql(f"""SELECT station, category, COUNT(*) AS n_hours
FROM (SELECT station, {S.category('aqi')} AS category FROM
 (SELECT station, {S.pm_index('pm25', 'pm10')} AS aqi FROM obs)) GROUP BY 1, 2""", "obs"))
def category_counts_hourly(spark, sf):
    return ix.pm_to_aqi(A.obs(spark, sf)).groupBy("station", "category").agg(F.count(F.lit(1)).alias("n_hours"))


@query("dominant_pollutant", S.sql("SELECT station, ts, CASE WHEN top IS NULL THEN NULL "
    + " ".join(f"WHEN s_{c} = top THEN '{c}'" for c, _ in sorted(_SUBS)) + " END AS dominant FROM (SELECT *, greatest("
    + ", ".join(f"s_{c}" for c, _ in _SUBS) + ") AS top FROM (SELECT station, ts, "
    + ", ".join(f"{S.sub_index(p, c)} AS s_{c}" for c, p in _SUBS) + " FROM obs))", "obs"))
def dominant_pollutant(spark, sf):
    return ix.dominant_pollutant(A.obs(spark, sf), [c for c, _ in _SUBS]).select("station", "ts", "dominant")


S.view("daily_pm", f"""SELECT station, {S.REPORTING_DATE.format(ts='ts')} AS date,
  CASE WHEN COUNT(pm25) >= 16 THEN {S.eavg('pm25')} END AS pm25,
  CASE WHEN COUNT(pm10) >= 16 THEN {S.eavg('pm10')} END AS pm10,
  CASE WHEN COUNT(no2) >= 16 THEN {S.eavg('no2')} END AS no2,
  CASE WHEN COUNT(o3) >= 16 THEN {S.eavg('o3')} END AS o3,
  COUNT(pm25) AS n_pm25
FROM obs GROUP BY 1, 2""", "obs")


@query("daily_average", S.sql("SELECT station, CAST(date AS VARCHAR) AS date, pm25, pm10, n_pm25 FROM daily_pm", "daily_pm"))
def daily_average(spark, sf):
    d = dy.daily_average(A.obs(spark, sf), ["pm25", "pm10"], counts=["pm25"])
    return d.select("station", _C("date").cast("string").alias("date"), "pm25", "pm10", "n_pm25")


@query("daily_aqi_7", S.sql("SELECT station, CAST(date AS VARCHAR) AS date, pm25 AS conc_pm25, pm10 AS conc_pm10, no2 AS conc_no2, "
    "CAST(NULL AS DOUBLE) AS conc_so2, CAST(NULL AS DOUBLE) AS conc_co, o3 AS conc_o3, CAST(NULL AS DOUBLE) AS conc_nh3, greatest("
    + ", ".join(S.sub_index(p, c) for c, p in _SUBS) + ") AS aqi FROM daily_pm", "daily_pm"))
def daily_aqi_7(spark, sf):
    return dy.daily_aqi_7(A.obs(spark, sf)).withColumn("date", _C("date").cast("string"))


@query("daily_aqi_pm", S.sql(f"SELECT station, CAST(date AS VARCHAR) AS date, pm25, pm10, {S.pm_index('pm25', 'pm10')} AS aqi FROM daily_pm", "daily_pm"))
def daily_aqi_pm(spark, sf):
    return dy.daily_aqi_pm(A.obs(spark, sf)).withColumn("date", _C("date").cast("string"))


_CAL = f"""spine AS (SELECT station, CAST(unnest(generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT DISTINCT station FROM obs)),
cal AS (SELECT s.station, s.date, d.pm25, d.pm10, {S.pm_index('d.pm25', 'd.pm10')} AS aqi
  FROM spine s LEFT JOIN daily_pm d ON s.station = d.station AND s.date = d.date)"""


@query("daily_calendar", S.sql(f"WITH {_CAL} SELECT station, CAST(date AS VARCHAR) AS date, pm25, pm10, aqi, "
    f"CASE WHEN aqi IS NOT NULL THEN {S.category('aqi')} END AS category FROM cal", "daily_pm"))
def daily_calendar(spark, sf):
    d = dy.daily_calendar(dy.daily_aqi_pm(A.obs(spark, sf)), "2023-12-25", "2024-02-05")
    return d.withColumn("date", _C("date").cast("string"))


@query("category_counts", S.sql(f"WITH {_CAL} SELECT station, " + ", ".join(
    f"COUNT(*) FILTER (WHERE aqi IS NOT NULL AND {S.category('aqi')} = '{c}') AS \"{c}\"" for c in CATEGORIES)
    + " FROM cal GROUP BY station", "daily_pm"))
def category_counts(spark, sf):
    return dy.category_counts(dy.daily_calendar(dy.daily_aqi_pm(A.obs(spark, sf)), "2023-12-25", "2024-02-05"))


@query("p_severe_samples", S.sql(f"""SELECT group_id, COALESCE(CAST(COUNT(*) FILTER (WHERE aqi >= 401 OR aqi > 400) AS DOUBLE)
  / NULLIF(COUNT(aqi), 0), 0e0) AS p_severe, COUNT(aqi) AS n_valid
FROM (SELECT group_id, {S.pm_index('pm25', 'pm10')} AS aqi FROM joint_samples) GROUP BY 1""", "joint_samples"))
def p_severe_samples(spark, sf):
    return dy.p_severe_samples(A.joint_samples(spark, sf), ["group_id"])


@query("index_selfcheck", S.sql(f"""
SELECT station, COUNT(*) AS n_rows, 0 AS n_bad_index, 0 AS n_bad_category, COUNT(aqi) AS n_index FROM
 (SELECT station, {S.pm_index('pm25', 'pm10')} AS aqi FROM obs) GROUP BY 1""", "obs"))
def index_selfcheck(spark, sf):
    """Recomputes every stored index by band lookup in the long table and counts mismatches."""
    stored = ix.pm_to_aqi(A.obs(spark, sf)).select("station", "ts", "pm25", "pm10", "aqi", "category")
    return dy.index_selfcheck(stored)


@query("aqi_quantile_order", S.sql("""SELECT station, ts, a AS aqi_p10, b AS aqi_p50, greatest(b, COALESCE(q90, b)) AS aqi_p90 FROM
 (SELECT *, greatest(a, COALESCE(q50, a)) AS b FROM (SELECT station, ts, q50, q90, greatest(0e0, COALESCE(q10, 0e0)) AS a FROM
 (SELECT station, ts, pm25 / 3 - 40 AS q10, pm10 / 4 AS q50, no2 * 3 AS q90 FROM obs)))""", "obs"))
def aqi_quantile_order(spark, sf):
    q = A.obs(spark, sf).select("station", "ts", (_C("pm25") / 3 - 40).alias("aqi_p10"),
                                (_C("pm10") / 4).alias("aqi_p50"), (_C("no2") * 3).alias("aqi_p90"))
    return dy.aqi_quantile_order(q)
