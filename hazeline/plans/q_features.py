"""Registered queries of joins, features, bias, bands and the 72-hour forecast."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeline.constants import (
    BAND_FLOOR, BLEND_WEIGHTS, DRIVER_OF, FALLBACK_BAND, POLLUTANTS,
)
from hazeline.functions.numeric import round_half_even
from hazeline.operators import bands as bd
from hazeline.operators import bias as bs
from hazeline.operators import features as ft
from hazeline.plans import forecast as fc
from hazeline.plans import sqltext as S
from hazeline.plans.registry import plan
from hazeline.sources import readers as rd
from hazeline.sources import sinks as sk
from hazeline.session import durable

_C = F.col
SEASONS = [("2024-01-01", "2024-01-20"), ("2024-01-21", "2024-01-30")]
WHOLE = [("2024-01-01", "2024-01-30")]


def _r(df, *names, digits=6):
    return df.withColumns({n: round_half_even(_C(n), digits) for n in names})


def _issues_sql(seasons, step):
    parts = [
        f"SELECT station, unnest(generate_series(TIMESTAMP '{a} 00:00:00', TIMESTAMP '{b} 23:00:00' - INTERVAL 72 HOUR, INTERVAL {step} HOUR)) AS issue_time FROM stations"
        for a, b in seasons
    ]
    return " UNION ALL ".join(parts)


S.view("issues", _issues_sql(SEASONS, 12), "stations")
S.view("daily_issues", _issues_sql(WHOLE, 24), "stations")


def issues(t):
    return ft.issue_times(t.stations, SEASONS, 12)


def daily_issues(t):
    return ft.issue_times(t.stations, WHOLE, 24)


def _pers_sql(table):
    return "SELECT i.station, i.issue_time, " + ", ".join(
        f"arg_max(o.{p}, o.ts) FILTER (WHERE o.{p} IS NOT NULL) AS last_obs_{p}" for p in POLLUTANTS
    ) + f""" FROM {table} i LEFT JOIN obs o ON o.station = i.station AND o.ts <= i.issue_time
    AND o.ts >= i.issue_time - INTERVAL 24 HOUR GROUP BY 1, 2"""


S.view("persisted", _pers_sql("issues"), "issues", "obs")
S.view("daily_persisted", _pers_sql("daily_issues"), "daily_issues", "obs")

_TIME = {
    "hour_sin": "sin(hour(valid_time) * (2 * pi()) / 24)", "hour_cos": "cos(hour(valid_time) * (2 * pi()) / 24)",
    "doy_sin": "sin(dayofyear(valid_time) * (2 * pi()) / 365.25)", "doy_cos": "cos(dayofyear(valid_time) * (2 * pi()) / 365.25)",
}


def _samples_sql(pers):
    return f"""SELECT b.station, b.issue_time, b.lead_h, b.valid_time, b.last_obs_pm25, b.last_obs_pm10, b.last_obs_o3, b.last_obs_no2,
 d.pm2_5 AS driver_pm25, d.pm10 AS driver_pm10, d.ozone AS driver_o3, d.nitrogen_dioxide AS driver_no2,
 d.temperature_2m, d.relative_humidity_2m, COALESCE(d.wind_speed_10m, 0) AS wind_speed_10m, d.wind_direction_10m,
 COALESCE(d.boundary_layer_height, 0) AS boundary_layer_height, d.surface_pressure,
 COALESCE(d.boundary_layer_height, 0) * (COALESCE(d.wind_speed_10m, 0) / 3.6e0) AS ventilation_index,
 CAST(hour(b.valid_time) AS INTEGER) AS hour, CAST(dayofyear(b.valid_time) AS INTEGER) AS day_of_year,
 {", ".join(f"{S.rnd(e.replace('valid_time', 'b.valid_time'), 9)} AS {n}" for n, e in _TIME.items())},
 o.pm25 AS target_pm25, o.pm10 AS target_pm10, o.o3 AS target_o3, o.no2 AS target_no2
FROM (SELECT p.*, CAST(h AS INTEGER) AS lead_h, issue_time + to_hours(CAST(h AS INTEGER)) AS valid_time FROM {pers} p, range(1, 73) t(h)) b
JOIN drivers d ON d.station = b.station AND d.ts = b.valid_time
LEFT JOIN obs o ON o.station = b.station AND o.ts = b.valid_time"""


S.view("samples", _samples_sql("persisted"), "persisted", "drivers", "obs")
S.view("daily_samples", _samples_sql("daily_persisted"), "daily_persisted", "drivers", "obs")


@plan("persistence_24h", S.sql("SELECT * FROM persisted", "persisted"))
def persistence_24h(t):
    return ft.persistence_24h(issues(t), t.obs)


@plan("issue_times", S.sql("SELECT * FROM issues", "issues"))
def issue_times(t):
    return issues(t)


@plan("lead_expand", S.sql("SELECT station, issue_time, valid_time, lead_h, driver_pm25 FROM samples", "samples"))
def lead_expand(t):
    return ft.lead_expand(issues(t), t.drivers).select(
        "station", "issue_time", "valid_time", "lead_h", _C("pm2_5").alias("driver_pm25"))


@plan("targets_at_valid_time", S.sql("SELECT station, issue_time, valid_time, lead_h, target_pm25, target_pm10, target_o3, target_no2 FROM samples", "samples"))
def targets_at_valid_time(t):
    leads = ft.lead_expand(issues(t), t.drivers).select("station", "issue_time", "valid_time", "lead_h")
    return ft.targets_at_valid_time(leads, t.obs)


def samples(t):
    return ft.samples_72h(t.obs, t.drivers, t.stations, SEASONS, 12)


@plan("samples_72h", S.sql("SELECT * FROM samples", "samples"))
def samples_72h(t):
    return _r(samples(t), *_TIME, digits=9)


@plan("leak_audit", S.sql("SELECT station, issue_time, 'pm25' AS pollutant, last_obs_pm25 AS used, last_obs_pm25 AS allowed FROM samples WHERE FALSE", "samples"))
def leak_audit(t):
    """Clean samples: nothing to report."""
    o = t.obs
    return ft.leak_audit(samples(t), o)


@plan("leak_audit_planted", S.sql("SELECT DISTINCT station, issue_time, 'pm25' AS pollutant, last_obs_pm25 + 1 AS used, last_obs_pm25 AS allowed FROM samples WHERE station = 'st1' AND last_obs_pm25 IS NOT NULL", "samples"))
def leak_audit_planted(t):
    """Persistence of one station is off by one everywhere: exactly those values are found."""
    wrong = samples(t).withColumn("last_obs_pm25", F.when(_C("station") == "st1", _C("last_obs_pm25") + 1).otherwise(_C("last_obs_pm25")))
    return ft.leak_audit(wrong, t.obs)


@plan("winter_split", S.sql("""SELECT part, COUNT(*) AS n_rows, COUNT(target_pm25) AS n_targets FROM (SELECT *, CASE
 WHEN valid_time >= TIMESTAMP '2024-01-01' AND valid_time <= TIMESTAMP '2024-01-20 23:00:00' THEN 'train'
 WHEN valid_time >= TIMESTAMP '2024-01-21' AND valid_time <= TIMESTAMP '2024-01-30 23:00:00' THEN 'test' END AS part FROM samples) WHERE part IS NOT NULL GROUP BY 1""", "samples"))
def winter_split(t):
    return ft.split_by_winter(samples(t), SEASONS[:1], SEASONS[1]).groupBy("part").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("target_pm25").alias("n_targets"))


@plan("ventilation_index", S.sql("SELECT station, ts, COALESCE(blh, 0) * (COALESCE(ws, 0) / 3.6e0) AS ventilation_index FROM (SELECT station, ts, CASE WHEN hour(ts) <> 3 THEN boundary_layer_height END AS blh, CASE WHEN hour(ts) <> 4 THEN wind_speed_10m END AS ws FROM drivers)", "drivers"))
def ventilation_index(t):
    blh = F.when(F.hour("ts") != 3, _C("boundary_layer_height"))
    ws = F.when(F.hour("ts") != 4, _C("wind_speed_10m"))
    return t.drivers.select("station", "ts", ft.ventilation_index(blh, ws).alias("ventilation_index"))


@plan("cyclic_features", S.sql("SELECT station, ts AS valid_time, CAST(hour(ts) AS INTEGER) AS hour, CAST(dayofyear(ts) AS INTEGER) AS day_of_year, "
    + ", ".join(f"{S.rnd(e.replace('valid_time', 'ts'), 9)} AS {n}" for n, e in _TIME.items()) + " FROM drivers", "drivers"))
def cyclic_features(t):
    d = t.drivers.select("station", _C("ts").alias("valid_time"))
    return _r(d.withColumns(ft.time_features()), *_TIME, digits=9)


@plan("calendar_lag", S.sql("""SELECT d.station, CAST(d.date AS VARCHAR) AS date, d.aqi, p.aqi AS aqi_lag FROM daily_long d
LEFT JOIN daily_long p ON p.station = d.station AND p.date = d.date - 1""", "daily_long"))
def calendar_lag(t):
    return ft.calendar_lag(t.daily_long).withColumn("date", _C("date").cast("string"))


_LABELS = [(h, e, v) for h in (1, 2, 3) for e, v in ft.EVENTS.items()]
S.view("labels_daily", "SELECT d.station, d.date, d.aqi AS aqi_t, p.aqi AS aqi_t_minus_1, CAST(year(d.date) AS INTEGER) AS year, CAST(month(d.date) AS INTEGER) AS month, "
    f"{S.rnd('sin(month(d.date) * (2 * pi()) / 12)', 9)} AS month_sin, {S.rnd('cos(month(d.date) * (2 * pi()) / 12)', 9)} AS month_cos, "
    + ", ".join(f"CASE WHEN t{h}.aqi IS NOT NULL THEN CAST(t{h}.aqi >= {v} AS DOUBLE) END AS y_{e}_h{h}" for h, e, v in _LABELS)
    + " FROM daily_long d LEFT JOIN daily_long p ON p.station = d.station AND p.date = d.date - 1 "
    + " ".join(f"LEFT JOIN daily_long t{h} ON t{h}.station = d.station AND t{h}.date = d.date + {h}" for h in (1, 2, 3)), "daily_long")


@plan("horizon_labels", S.sql("SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM labels_daily", "labels_daily"))
def horizon_labels(t):
    return _r(ft.horizon_labels(t.daily_long), "month_sin", "month_cos", digits=9).withColumn("date", _C("date").cast("string"))


@plan("split_counts", S.sql("""SELECT part, year, COUNT(*) AS n_rows, COUNT(y_severe_h1) AS n_labels, CAST(SUM(y_severe_h1) AS BIGINT) AS n_events FROM (
 SELECT *, CASE WHEN year IN (1996, 1998) THEN 'train' WHEN year = 2000 THEN 'test' END AS part FROM labels_daily WHERE month IN (10, 11, 12, 1, 2))
WHERE part IS NOT NULL GROUP BY 1, 2""", "labels_daily"))
def split_counts(t):
    split = ft.split_by_year(ft.horizon_labels(t.daily_long), (1996, 1998), 2000)
    return split.groupBy("part", "year").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("y_severe_h1").alias("n_labels"), F.sum("y_severe_h1").cast("long").alias("n_events"))


_W7 = "(PARTITION BY station ORDER BY date RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)"
S.view("mean7", f"""SELECT station, date, aqi, pm25, pm10, CASE WHEN COUNT(CASE WHEN aqi > 0 THEN aqi END) OVER {_W7} = 7
 THEN {S.wavg('(CASE WHEN aqi > 0 THEN aqi END)', _W7)} END AS mean_aqi_7d FROM daily_long""", "daily_long")


@plan("contiguous_mean_7d", S.sql("SELECT station, CAST(date AS VARCHAR) AS date, mean_aqi_7d FROM mean7", "mean7"))
def contiguous_mean_7d(t):
    return ft.contiguous_mean_7d(t.daily_long).select("station", _C("date").cast("string").alias("date"), "mean_aqi_7d")


S.view("feats", f"""SELECT m.station, m.date, m.aqi AS aqi_d, p.aqi AS aqi_d_minus_1, m.mean_aqi_7d, m.pm10 / m.pm25 AS pm_ratio,
 {S.rnd('sin(month(m.date) * (2 * pi()) / 12)', 9)} AS month_sin, {S.rnd('cos(month(m.date) * (2 * pi()) / 12)', 9)} AS month_cos
FROM mean7 m JOIN daily_long p ON p.station = m.station AND p.date = m.date - 1
WHERE m.aqi > 0 AND p.aqi > 0 AND m.mean_aqi_7d IS NOT NULL AND m.pm25 > 0 AND m.pm10 >= 0""", "mean7")


@plan("daily_features", S.sql("SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM feats", "feats"))
def daily_features(t):
    return _r(ft.daily_features(t.daily_long), "month_sin", "month_cos", digits=9).withColumn("date", _C("date").cast("string"))


# --- bias and bands

S.view("residual_rows", "SELECT * FROM (UNPIVOT (SELECT o.station, o.ts, " + ", ".join(f"o.{p} - d.{DRIVER_OF[p]} AS {p}" for p in POLLUTANTS)
    + " FROM obs o JOIN drivers d ON o.station = d.station AND o.ts = d.ts) ON pm25, pm10, o3, no2 INTO NAME pollutant VALUE residual)", "obs", "drivers")
_ROLL = "(PARTITION BY station, pollutant ORDER BY ts RANGE BETWEEN INTERVAL '6 days 23:59:59.999999' PRECEDING AND CURRENT ROW)"
S.view("bias", f"SELECT station, ts, pollutant, residual, CASE WHEN COUNT(residual) OVER {_ROLL} >= 6 THEN {S.wavg('residual', _ROLL)} END AS bias_7d FROM residual_rows", "residual_rows")
S.view("pollutants", "SELECT * FROM (VALUES ('pm25'), ('pm10'), ('o3'), ('no2')) t(pollutant)")
S.view("bias_issue", """SELECT i.station, i.issue_time, p.pollutant, arg_max(b.bias_7d, b.ts) FILTER (WHERE b.bias_7d IS NOT NULL) AS bias_7d
FROM issues i CROSS JOIN pollutants p LEFT JOIN bias b ON b.station = i.station AND b.pollutant = p.pollutant AND b.ts <= i.issue_time GROUP BY 1, 2, 3""",
    "issues", "pollutants", "bias")


@plan("rolling_bias_7d", S.sql("SELECT * FROM bias", "bias"))
def rolling_bias_7d(t):
    return bs.rolling_bias_7d(t.obs, t.drivers)


@plan("bias_asof", S.sql("SELECT * FROM bias_issue", "bias_issue"))
def bias_asof(t):
    return bs.bias_asof(issues(t), durable(bs.rolling_bias_7d(t.obs, t.drivers)))


@plan("bias_at_issue", S.sql("SELECT station, issue_time, pollutant, COALESCE(bias_7d, 0) AS bias_7d FROM bias_issue", "bias_issue"))
def bias_at_issue(t):
    return bs.bias_at_issue(issues(t), durable(bs.rolling_bias_7d(t.obs, t.drivers)))


@plan("driver_bias_corrected", S.sql("SELECT o.station, o.ts, CASE WHEN o.pm25 IS NOT NULL THEN greatest(0e0, d.pm2_5 + (o.pm25 - 300)) END AS corrected FROM obs o JOIN drivers d ON o.station = d.station AND o.ts = d.ts", "obs", "drivers"))
def driver_bias_corrected(t):
    j = t.obs.join(t.drivers.select("station", "ts", "pm2_5"), ["station", "ts"])
    return j.select("station", "ts", bs.driver_bias_corrected(_C("pm2_5"), _C("pm25") - 300).alias("corrected"))


def _weight_sql(p, lead="lead_h"):
    a, b, c = BLEND_WEIGHTS[p]
    return f"(CASE WHEN {lead} <= 24 THEN {S.num(a)} WHEN {lead} <= 48 THEN {S.num(b)} ELSE {S.num(c)} END)"


def _blend_sql(p, pers, bc):
    w = _weight_sql(p)
    return f"CASE WHEN {pers} IS NULL THEN {bc} ELSE {w} * {pers} + (1e0 - {w}) * {bc} END"


S.view("candidates", "SELECT s.*, " + ", ".join(f"COALESCE(b_{p}.bias_7d, 0) AS bias_{p}, CASE WHEN s.driver_{p} IS NOT NULL THEN greatest(0e0, s.driver_{p} + COALESCE(b_{p}.bias_7d, 0)) END AS bc_{p}" for p in POLLUTANTS)
    + " FROM samples s " + " ".join(f"LEFT JOIN bias_issue b_{p} ON b_{p}.station = s.station AND b_{p}.issue_time = s.issue_time AND b_{p}.pollutant = '{p}'" for p in POLLUTANTS), "samples", "bias_issue")


@plan("lead_blend", S.sql("SELECT station, issue_time, lead_h, " + ", ".join(f"bc_{p}, {_blend_sql(p, f'last_obs_{p}', f'bc_{p}')} AS blend_{p}" for p in POLLUTANTS) + " FROM candidates", "candidates"))
def lead_blend(t):
    from hazeline.plans.verification import with_candidates

    c = with_candidates(issues(t), t.obs, t.drivers)
    return c.select("station", "issue_time", "lead_h", *[f"bc_{p}" for p in POLLUTANTS], *[f"blend_{p}" for p in POLLUTANTS])


def _guard_sql(t):
    return f"""SELECT i.station, i.issue_time,
 {S.rnd("(epoch_us(i.issue_time) - epoch_us(COALESCE(MAX(o.ts) FILTER (WHERE o.pm25 IS NOT NULL), MAX(o.ts)))) / 3600000000", 1)} AS newest_obs_age_hours,
 COUNT(o.pm25) FILTER (WHERE o.ts >= i.issue_time - INTERVAL 7 DAY) AS recent_obs_count_7d,
 CASE WHEN COUNT(o.pm25) FILTER (WHERE o.ts >= i.issue_time - INTERVAL 7 DAY) >= 6 THEN 'applied' ELSE 'unavailable_no_recent_obs' END AS bias_correction
FROM {t} i LEFT JOIN obs o ON o.station = i.station AND o.ts <= i.issue_time GROUP BY 1, 2"""


def _at(p):
    at = f"({S.num(p)} * (len(v) - 1))"
    lo, hi = f"v[CAST(floor({at}) AS BIGINT) + 1]", f"v[CAST(ceil({at}) AS BIGINT) + 1]"
    return f"{lo} + ({at} - floor({at})) * ({hi} - {lo})"


def _resq_sql(t):
    return f"""SELECT station, issue_time, pollutant, n_pairs, CASE WHEN n_pairs >= 6 THEN mean ELSE 0e0 END AS res_mean,
 CASE WHEN n_pairs >= 6 THEN {_at(0.1)} ELSE -15e0 END AS res_p10, CASE WHEN n_pairs >= 6 THEN {_at(0.5)} ELSE 0e0 END AS res_p50,
 CASE WHEN n_pairs >= 6 THEN {_at(0.9)} ELSE 15e0 END AS res_p90
FROM (SELECT i.station, i.issue_time, p.pollutant, COUNT(r.residual) AS n_pairs, {S.eavg('r.residual')} AS mean,
  list_sort(list(r.residual) FILTER (WHERE r.residual IS NOT NULL)) AS v
 FROM {t} i CROSS JOIN pollutants p LEFT JOIN residual_rows r ON r.station = i.station AND r.pollutant = p.pollutant
 AND r.ts <= i.issue_time AND r.ts >= i.issue_time - INTERVAL 7 DAY GROUP BY 1, 2, 3)"""


S.view("guard", _guard_sql("issues"), "issues", "obs")
S.view("daily_guard", _guard_sql("daily_issues"), "daily_issues", "obs")
S.view("resq", _resq_sql("issues"), "issues", "pollutants", "residual_rows")
S.view("daily_resq", _resq_sql("daily_issues"), "daily_issues", "pollutants", "residual_rows")


@plan("staleness_guard", S.sql("SELECT * FROM guard", "guard"))
def staleness_guard(t):
    return bs.staleness_guard(issues(t), t.obs)


@plan("residual_quantiles", S.sql("SELECT station, issue_time, pollutant, n_pairs, " + ", ".join(f"{S.rnd(c, 6)} AS {c}" for c in ("res_mean", "res_p10", "res_p50", "res_p90")) + " FROM resq", "resq"))
def residual_quantiles(t):
    return _r(bs.residual_quantiles(issues(t), t.obs, t.drivers), "res_mean", "res_p10", "res_p50", "res_p90")


def _pivot_resq(t):
    return "SELECT station, issue_time, " + ", ".join(
        f"MAX(CASE WHEN pollutant = '{p}' THEN res_{s} END) AS {p}_{s}" for p in POLLUTANTS for s in ("mean", "p10", "p90")) + f" FROM {t} GROUP BY 1, 2"


def _blend_band_sql(p, s="s"):
    d, mean, q10, q90 = f"{s}.driver_{p}", f"r.{p}_mean", f"r.{p}_p10", f"r.{p}_p90"
    widen, fl = f"(1e0 + 0.004e0 * {s}.lead_h)", S.num(BAND_FLOOR[p])
    bc = f"greatest(0e0, {d} + {mean})"
    if p in ("pm25", "pm10"):
        mid, low, high = bc, f"greatest({fl}, {mean} - {q10}) * {widen}", f"greatest({fl}, {q90} - {mean}) * {widen}"
    else:
        w, last = _weight_sql(p, f"{s}.lead_h"), f"{s}.last_obs_{p}"
        mid = f"(CASE WHEN {last} IS NULL THEN {bc} ELSE {w} * {last} + (1e0 - {w}) * {bc} END)"
        low = high = f"greatest({fl}, ({q90} - {q10}) / 2e0) * {widen}"
    return f"greatest(0e0, {mid} - {low})", mid, f"{mid} + {high}"


def _fallback_sql(p, s="s"):
    least, share = FALLBACK_BAND[p]
    d = f"{s}.driver_{p}"
    half = f"greatest({S.num(least)}, {S.num(share)} * {d}) * (1e0 + 0.004e0 * {s}.lead_h)"
    return f"greatest(0e0, {d} - {half})", d, f"{d} + {half}"


_Q = ("p10", "p50", "p90")


@plan("blend_bands", S.sql(f"WITH r AS ({_pivot_resq('resq')}) SELECT s.station, s.issue_time, s.lead_h, " + ", ".join(
    f"{S.rnd(e, 6)} AS {p}_{q}" for p in POLLUTANTS for q, e in zip(_Q, _blend_band_sql(p)))
    + " FROM samples s LEFT JOIN r ON r.station = s.station AND r.issue_time = s.issue_time", "samples", "resq"))
def blend_bands(t):
    o, d = t.obs, t.drivers
    b = bd.blend_bands(samples(t), bs.residual_quantiles(issues(t), o, d))
    names = [f"{p}_{q}" for p in POLLUTANTS for q in _Q]
    return _r(b.select("station", "issue_time", "lead_h", *names), *names)


@plan("fallback_bands", S.sql("SELECT s.station, s.issue_time, s.lead_h, " + ", ".join(
    f"{e} AS {p}_{q}" for p in POLLUTANTS for q, e in zip(_Q, _fallback_sql(p))) + " FROM samples s", "samples"))
def fallback_bands(t):
    return bd.fallback_bands(samples(t)).select("station", "issue_time", "lead_h", *[f"{p}_{q}" for p in POLLUTANTS for q in _Q])


@plan("monotone_quantiles", S.sql("""SELECT station, ts, a AS pm_p10, b AS pm_p50, greatest(b, q90) AS pm_p90 FROM (SELECT *, greatest(a, q50) AS b FROM
 (SELECT station, ts, pm10 / 2 AS q50, pm25 * 1.1e0 AS q90, greatest(0e0, pm25 - 200) AS a FROM obs WHERE pm25 IS NOT NULL AND pm10 IS NOT NULL))""", "obs"))
def monotone_quantiles(t):
    o = t.obs.where("pm25 IS NOT NULL AND pm10 IS NOT NULL").select(
        "station", "ts", (_C("pm25") - 200).alias("q10"), (_C("pm10") / 2).alias("q50"), (_C("pm25") * 1.1).alias("q90"))
    return bd.monotone_quantiles(o, {"pm": ("q10", "q50", "q90")}).drop("q10", "q50", "q90")


def _bands_cte():
    cols = ", ".join(
        f"{S.rnd(f'CASE WHEN g.bias_correction = ' + chr(39) + 'applied' + chr(39) + f' THEN {a} ELSE {b} END', 1)} AS {p}_{q}"
        for p in POLLUTANTS for q, a, b in zip(_Q, _blend_band_sql(p), _fallback_sql(p)))
    return f"""r AS ({_pivot_resq('daily_resq')}),
bands AS (SELECT s.station, s.issue_time, s.valid_time, s.lead_h, {cols}, g.bias_correction, g.newest_obs_age_hours, g.recent_obs_count_7d
 FROM daily_samples s JOIN daily_guard g ON g.station = s.station AND g.issue_time = s.issue_time LEFT JOIN r ON r.station = s.station AND r.issue_time = s.issue_time),
ix AS (SELECT *, {", ".join(f"{S.pm_index(f'pm25_{q}', f'pm10_{q}')} AS i_{q}" for q in _Q)} FROM bands),
i2 AS (SELECT *, greatest(0e0, COALESCE(i_p10, 0e0)) AS aqi_p10, {S.category('i_p50')} AS category FROM ix),
i3 AS (SELECT *, greatest(aqi_p10, COALESCE(i_p50, aqi_p10)) AS aqi_p50 FROM i2),
i4 AS (SELECT *, greatest(aqi_p50, COALESCE(i_p90, aqi_p50)) AS aqi_p90 FROM i3)"""


_Z = "z AS (SELECT * FROM (VALUES " + ", ".join(f"({S.num(a)}, {S.num(b)})" for a, b in bd.normal_pairs()) + ") t(za, zb))"
_RISK = f"""pick AS (SELECT station, issue_time, h, COALESCE(MAX(CASE WHEN lead_h = h THEN lead_h END), MAX(lead_h)) AS lead_h FROM bands, (VALUES (24), (48), (72)) t(h) GROUP BY 1, 2, 3),
draws AS (SELECT p.station, p.issue_time, p.h,
  greatest(0e0, b.pm25_p50 + greatest(5e0, (b.pm25_p90 - b.pm25_p10) / 2.563e0) * z.za) AS v25,
  greatest(0e0, b.pm10_p50 + greatest(5e0, (b.pm10_p90 - b.pm10_p10) / 2.563e0) * z.zb) AS v10
  FROM pick p JOIN bands b ON b.station = p.station AND b.issue_time = p.issue_time AND b.lead_h = p.lead_h CROSS JOIN z),
risk0 AS (SELECT station, issue_time, h, {S.rnd("CAST(COUNT(*) FILTER (WHERE x >= 401 OR x > 400) AS DOUBLE) / 100", 4)} AS p FROM (SELECT *, {S.pm_index('v25', 'v10')} AS x FROM draws) GROUP BY 1, 2, 3),
risk AS (SELECT station, issue_time, MAX(p) FILTER (WHERE h = 24) AS p_severe_24h, MAX(p) FILTER (WHERE h = 48) AS p_severe_48h, MAX(p) FILTER (WHERE h = 72) AS p_severe_72h FROM risk0 GROUP BY 1, 2)"""

_FORECAST_NEEDS = ("daily_samples", "daily_guard", "daily_resq")


def forecast(t):
    return fc.forecast_72h(t.obs, t.drivers, daily_issues(t))


_STAGED = f"WITH {_bands_cte()}, {_Z}, {_RISK}"
for _stage in ("bands", "i4", "pick", "draws", "risk"):
    _STAGED = _STAGED.replace(f"\n{_stage} AS (", f"\n{_stage} AS MATERIALIZED (").replace(f", {_stage} AS (", f", {_stage} AS MATERIALIZED (")


@plan("forecast_72h", S.sql(f"{_STAGED} SELECT i4.station, i4.issue_time, valid_time, lead_h, "
    + ", ".join(fc.QUANTILE_NAMES) + ", category, bias_correction, newest_obs_age_hours, recent_obs_count_7d, p_severe_24h, p_severe_48h, p_severe_72h "
    "FROM i4 JOIN risk ON risk.station = i4.station AND risk.issue_time = i4.issue_time", *_FORECAST_NEEDS, once=True))
def forecast_72h(t):
    return forecast(t)


@plan("p_severe_mc", S.sql(f"WITH {_bands_cte()}, {_Z}, {_RISK} SELECT * FROM risk", *_FORECAST_NEEDS))
def p_severe_mc(t):
    o, d, i = t.obs, t.drivers, daily_issues(t)
    bands = bd.quantile_bands(ft.samples_for_issues(i, o, d), bs.staleness_guard(i, o), bs.residual_quantiles(i, o, d))
    return bd.p_severe_mc(bands)


@plan("forecast_json")
def forecast_json(t):
    return fc.forecast_json(forecast(t), t.stations)


@plan("forecast_documents", S.sql(f"{_STAGED} SELECT i4.station, s.name AS station_name, i4.issue_time, valid_time, lead_h, "
    + ", ".join(fc.QUANTILE_NAMES) + ", category, bias_correction, newest_obs_age_hours, recent_obs_count_7d, p_severe_24h, p_severe_48h, p_severe_72h, "
    "COUNT(*) OVER (PARTITION BY i4.issue_time, i4.station) AS n_hours FROM i4 JOIN risk ON risk.station = i4.station AND risk.issue_time = i4.issue_time "
    "LEFT JOIN stations s ON s.station = i4.station", *_FORECAST_NEEDS, "stations", once=True))
def forecast_documents(t):
    """One nested document per issue and station, written below a manifest of issues, read back and taken apart again."""
    folder = sk.scratch_folder(t.spark, "forecast-documents")
    sk.write_documents(fc.forecast_documents(forecast(t), t.stations), folder)
    return fc.forecast_rows(rd.scan_documents(t.spark, folder))


@plan("replay_observed", S.sql(f"""WITH {_bands_cte()} SELECT i4.station, i4.issue_time, i4.valid_time, lead_h, aqi_p50, category, o.pm25 AS obs_pm25, o.pm10 AS obs_pm10,
 {S.pm_index('o.pm25', 'o.pm10')} AS obs_aqi, {S.category('(' + S.pm_index('o.pm25', 'o.pm10') + ')')} AS obs_category
FROM i4 LEFT JOIN obs o ON o.station = i4.station AND o.ts = i4.valid_time""", *_FORECAST_NEEDS))
def replay_observed(t):
    f = bd.replay_observed(forecast(t), t.obs)
    return f.select("station", "issue_time", "valid_time", "lead_h", "aqi_p50", "category", "obs_pm25", "obs_pm10", "obs_aqi", "obs_category")


@plan("driver_source_choice", S.sql("""WITH h AS (SELECT station, ts, pm2_5 FROM drivers WHERE NOT (station = 'st1' AND hour(ts) = 9)),
a AS (SELECT * FROM h WHERE ts > TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-13'),
c AS (SELECT station FROM a GROUP BY 1 HAVING COUNT(DISTINCT ts) >= 72)
SELECT station, ts, pm2_5, 'history' AS driver_source FROM a WHERE station IN (SELECT station FROM c)
UNION ALL SELECT station, ts, pm2_5 + 1, 'live' FROM drivers WHERE ts > TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-13' AND station NOT IN (SELECT station FROM c)""", "drivers"))
def driver_source_choice(t):
    d = t.drivers.select("station", "ts", "pm2_5")
    history = d.where(~((_C("station") == "st1") & (F.hour("ts") == 9)))
    live = d.withColumn("pm2_5", _C("pm2_5") + 1)
    return bd.choose_drivers(history, live, F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
