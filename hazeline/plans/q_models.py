"""Registered queries of fires, soundings, daily ridge forecasts and fitted models."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hazeline.constants import CATEGORIES, POLLUTANTS
from hazeline.functions.clock import utc_hhmm_to_local_hour
from hazeline.functions.numeric import round_half_even
from hazeline.operators import boosting as bo
from hazeline.operators import climatology as cm
from hazeline.operators import daily_verify as dv
from hazeline.operators import features as ft
from hazeline.operators import isotonic as iso
from hazeline.operators import fires as fi
from hazeline.operators import inversion as iv
from hazeline.operators import logistic as lg
from hazeline.operators import ridge as rg
from hazeline.operators import verify as vf
from hazeline.operators.bands import BAND_COLUMNS
from hazeline.plans import forecast as fc
from hazeline.plans import q_features as qf
from hazeline.plans import q_verify as qv
from hazeline.plans import sqltext as S
from hazeline.plans.registry import plan
from hazeline.session import durable, shared_folder

_C = F.col


@plan("fires_by_year", S.sql("SELECT CAST(year(acq_date) AS INTEGER) AS year, COUNT(*) AS n FROM fires WHERE month(acq_date) IN (10, 11) GROUP BY 1", "fires"))
def fires_by_year(t):
    return fi.fires_by_year(t.fires)


_IST = "CAST((((acq_time // 100) * 60 + acq_time % 100 + 330) % 1440) // 60 AS INTEGER)"


@plan("utc_to_ist_hour", S.sql(f"SELECT acq_time, {_IST} AS hour, COUNT(*) AS n FROM fires GROUP BY 1, 2", "fires"))
def utc_to_ist_hour(t):
    return t.fires.groupBy("acq_time", utc_hhmm_to_local_hour("acq_time").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@plan("overpass_histogram", S.sql(f"SELECT CAST(h AS INTEGER) AS hour, COUNT(f.hour) AS n FROM range(0, 24) t(h) LEFT JOIN (SELECT {_IST} AS hour FROM fires) f ON f.hour = h GROUP BY 1", "fires"))
def overpass_histogram(t):
    return fi.overpass_histogram(t.fires)


@plan("fires_by_confidence", S.sql("SELECT confidence, COUNT(*) AS n FROM fires WHERE confidence IS NOT NULL GROUP BY 1", "fires"))
def fires_by_confidence(t):
    return fi.fires_by_confidence(t.fires)


S.view("layers0", """SELECT profile, base_height, top_height, top_height - base_height AS depth_m, t1 - t0 AS strength_c,
 CASE WHEN base_rn = 1 THEN 'surface' ELSE 'elevated' END AS kind FROM (
 SELECT profile, seg, MIN(temp_c) AS t0, MAX(temp_c) AS t1, arg_max(height_m, (-temp_c, height_m)) AS base_height,
  arg_max(rn, (-temp_c, height_m)) AS base_rn, arg_min(height_m, (-temp_c, height_m)) AS top_height FROM (
  SELECT *, SUM(CASE WHEN temp_c < below THEN 1 ELSE 0 END) OVER (PARTITION BY profile ORDER BY height_m) AS seg FROM (
   SELECT *, lag(temp_c) OVER (PARTITION BY profile ORDER BY height_m) AS below, row_number() OVER (PARTITION BY profile ORDER BY height_m) AS rn FROM soundings))
 GROUP BY 1, 2) WHERE t1 > t0""", "soundings")


@plan("inversion_layers_tol0", S.sql("SELECT * FROM layers0", "layers0"))
def inversion_layers_tol0(t):
    return iv.inversion_layers_exact(t.soundings)


@plan("inversion_layers")
def inversion_layers(t):
    return iv.inversion_layers(t.soundings, tol_c=2.0, min_depth_m=50.0)


@plan("inversion_layers_scan0", S.sql("SELECT * FROM layers0 WHERE depth_m >= 100", "layers0"))
def inversion_layers_scan0(t):
    """The tolerance scan at tolerance zero must agree with the aggregate form."""
    return iv.inversion_layers(t.soundings, tol_c=0.0, min_depth_m=100.0)


@plan("strongest_inversion", S.sql("SELECT profile, base_height, top_height, depth_m, strength_c, kind FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY strength_c DESC, base_height) AS k FROM layers0) WHERE k = 1", "layers0"))
def strongest_inversion(t):
    return iv.strongest_inversion(iv.inversion_layers_exact(t.soundings))


@plan("bad_profiles", """SELECT profile, COUNT(*) AS violations FROM (SELECT l_partkey AS profile, l_orderkey AS h,
 lag(l_orderkey) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS below FROM lineitem) WHERE h <= below GROUP BY 1""")
def bad_profiles(t):
    return iv.bad_profiles(t.raw_soundings, ["o1", "o2", "o3", "o4", "o5"])


# --- daily ridge forecasts, winter by winter

_SEASON = "CASE WHEN month(date) >= 10 THEN CAST(year(date) AS INTEGER) WHEN month(date) <= 2 THEN CAST(year(date) - 1 AS INTEGER) END"
S.view("winter_days", f"SELECT *, {_SEASON} AS season FROM daily_long WHERE month(date) IN (10, 11, 12, 1, 2)", "daily_long")


def winter_days(t):
    return t.daily_long.withColumn("season", rg.winter_start(_C("date"))).where("season IS NOT NULL")


def winter_features(t):
    f = ft.daily_features(t.daily_long)
    return f.withColumn("season", rg.winter_start(_C("date"))).where("season IS NOT NULL")


S.view("ridge_train", f"""SELECT f.*, h.horizon, f.date + h.horizon AS target_date, ln(t.aqi) AS y, w.season FROM feats f
 JOIN winter_days w ON w.station = f.station AND w.date = f.date, (VALUES (1), (2), (3)) h(horizon), winter_days t
 WHERE t.station = f.station AND t.date = f.date + h.horizon AND t.season = w.season AND t.aqi > 0""", "feats", "winter_days")


def ridge_train(t):
    return rg.expanding_train(winter_features(t), winter_days(t))


def as_of(t):
    return winter_days(t).select("season", "date").distinct().withColumn("horizon", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))


@plan("expanding_train_counts", S.sql("""SELECT d.season, d.horizon, CAST(d.date AS VARCHAR) AS date, COUNT(t.y) AS n_train, """ + S.rnd("COALESCE(" + S.esum('t.aqi_d - 200', 12) + ", 0) + 200e0 * COUNT(t.y)", 6) + """ AS sum_aqi_d FROM
 (SELECT DISTINCT season, date, horizon FROM winter_days, (VALUES (1), (2), (3)) h(horizon)) d
 LEFT JOIN ridge_train t ON t.season = d.season AND t.horizon = d.horizon AND t.target_date <= d.date GROUP BY 1, 2, 3""", "ridge_train"))
def expanding_train_counts(t):
    m = rg.expanding_moments(ridge_train(t), as_of(t))
    total = _C("sx0") + rg.CENTRE[0] * _C("n_train")
    return m.select("season", "horizon", _C("date").cast("string").alias("date"), _C("n_train").cast("long").alias("n_train"), round_half_even(total, 6).alias("sum_aqi_d"))


def coefficients(t):
    return rg.ridge_expanding(rg.expanding_moments(ridge_train(t), as_of(t)))


@plan("ridge_coefficients")
def ridge_coefficients(t):
    return coefficients(t).withColumn("date", _C("date").cast("string"))


def daily_forecasts(t):
    return rg.daily_forecasts(winter_features(t), winter_days(t))


@plan("ridge_forecasts")
def ridge_forecasts(t):
    """Probabilistic forecasts with intervals, category map and top contributions."""
    return daily_forecasts(t).select(
        "season", _C("date").cast("string").alias("date"), "station", "horizon", "n_train", "point_aqi", "q10", "q90",
        "category_probabilities", "p_severe", "p_very_poor", "top_reasons")


@plan("top_contributions")
def top_contributions(t):
    f = rg.top_contributions(rg.predict_points(winter_features(t), coefficients(t)))
    return f.select("season", _C("date").cast("string").alias("date"), "station", "horizon", F.explode("top_reasons").alias("r")).select(
        "season", "date", "station", "horizon", "r.feature", "r.contribution", "r.feature_value")


_PD = f"""pts AS (SELECT w.season, w.date, w.station, t.aqi AS base FROM winter_days w JOIN winter_days t ON t.station = w.station AND t.date = w.date - 1 AND t.season = w.season WHERE t.aqi > 0),
res AS (SELECT season, ln(aqi) - 5e0 AS residual FROM winter_days WHERE aqi > 0),
smp AS (SELECT p.season, p.date, p.station, p.base, p.base * exp(r.residual) AS v FROM pts p JOIN res r ON r.season = p.season)"""


@plan("predictive_distribution", S.sql(f"WITH {_PD} SELECT season, CAST(date AS VARCHAR) AS date, station, COUNT(*) AS n_residuals, "
    + ", ".join(f"{S.rnd(f'CAST(COUNT(*) FILTER (WHERE {S.category('v')} = {chr(39)}{c}{chr(39)}) AS DOUBLE) / COUNT(*)', 4)} AS \"{c}\"" for c in CATEGORIES)
    + f""", {S.rnd('CAST(COUNT(*) FILTER (WHERE v >= 401) AS DOUBLE) / COUNT(*)', 4)} AS p_severe, {S.rnd('CAST(COUNT(*) FILTER (WHERE v >= 301) AS DOUBLE) / COUNT(*)', 4)} AS p_very_poor,
 {S.rnd('quantile_cont(v, 0.1)', 1)} AS q10, {S.rnd('quantile_cont(v, 0.9)', 1)} AS q90 FROM smp GROUP BY 1, 2, 3""", "winter_days"))
def predictive_distribution(t):
    """Distribution of yesterday's index times the season's spread (points and residuals in SQL reach)."""
    w = winter_days(t).select("season", "date", "station", "aqi")
    prev = w.select("season", "station", F.date_add("date", 1).alias("date"), _C("aqi").alias("base"))
    pts = w.join(prev, ["season", "station", "date"]).where("base > 0").select("season", "date", "station", F.log("base").alias("point"))
    res = w.where("aqi > 0").select("season", (F.log("aqi") - 5.0).alias("residual"))
    pts = pts.withColumn("station", F.concat_ws("|", "station", _C("date").cast("string")))
    d = rg.predictive_distribution(pts.drop("date"), res, ["season"])
    parts = F.split("station", r"\|")
    return d.select(
        "season", parts[1].alias("date"), parts[0].alias("station"), _C("n_residuals").cast("long").alias("n_residuals"),
        *[F.element_at("category_probabilities", F.lit(c)).alias(c) for c in CATEGORIES], "p_severe", "p_very_poor", "q10", "q90")


S.view("naive", """SELECT w.station, w.date, h.horizon, w.date + h.horizon AS target_date, w.aqi * 0.6e0 AS q10, w.aqi * 1.5e0 AS q90,
 least(1e0, w.aqi / 500) AS p_severe, least(1e0, w.aqi / 400) AS p_very_poor FROM daily_long w, (VALUES (1), (2), (3)) h(horizon)""", "daily_long")
S.view("evt_days", "SELECT date, CAST(month(date) AS INTEGER) AS month, COUNT(*) AS n, COUNT(*) FILTER (WHERE aqi >= 401) AS severe, COUNT(*) FILTER (WHERE aqi >= 301) AS very_poor FROM daily_long WHERE aqi > 0 GROUP BY 1, 2", "daily_long")
S.view("clim_exp", """SELECT a.date, a.month, COALESCE(SUM(e.severe) FILTER (WHERE e.month = a.month) / NULLIF(SUM(e.n) FILTER (WHERE e.month = a.month), 0), SUM(e.severe) / SUM(e.n), 0) AS clim_severe,
 COALESCE(SUM(e.very_poor) FILTER (WHERE e.month = a.month) / NULLIF(SUM(e.n) FILTER (WHERE e.month = a.month), 0), SUM(e.very_poor) / SUM(e.n), 0) AS clim_very_poor
FROM (SELECT DISTINCT date, CAST(month(target_date) AS INTEGER) AS month FROM naive) a LEFT JOIN evt_days e ON e.date <= a.date GROUP BY 1, 2""", "naive", "evt_days")


def naive_forecasts(t):
    d = t.daily_long.withColumn("horizon", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return d.select(
        "station", "date", "horizon", F.date_add("date", _C("horizon")).alias("target_date"),
        (_C("aqi") * 0.6).alias("q10"), (_C("aqi") * 1.5).alias("q90"),
        F.least(F.lit(1.0), _C("aqi") / 500).alias("p_severe"), F.least(F.lit(1.0), _C("aqi") / 400).alias("p_very_poor"))


@plan("climatology_expanding", S.sql(f"SELECT n.station, CAST(n.date AS VARCHAR) AS date, n.horizon, {S.rnd('clim_severe', 9)} AS clim_severe, {S.rnd('clim_very_poor', 9)} AS clim_very_poor FROM naive n JOIN clim_exp c ON c.date = n.date AND c.month = month(n.target_date)", "clim_exp"))
def climatology_expanding(t):
    c = cm.climatology_expanding(t.daily_long, naive_forecasts(t), ft.EVENTS)
    return c.select("station", _C("date").cast("string").alias("date"), "horizon", *[round_half_even(_C(f"clim_{e}"), 9).alias(f"clim_{e}") for e in ft.EVENTS])


def _de(e, thr):
    cols = {"model": f"p_{e}", "pers": f"pers_{e}", "clim": f"clim_{e}"}
    y = f"y_{e}"
    b = {k: S.eavg(f"({c} - {y}) * ({c} - {y})", 9) for k, c in cols.items()}
    out = [f"CAST(SUM({y}) AS BIGINT) AS n_events_{e}", f"CASE WHEN SUM({y}) < 10 THEN 'insufficient events' ELSE 'valid' END AS flag_{e}"]
    out += [f"{S.rnd(v, 4)} AS brier_{k}_{e}" for k, v in b.items()]
    for k in ("pers", "clim"):
        out.append(S.rnd(f"(CASE WHEN {b[k]} = {b['model']} THEN 0e0 WHEN {b[k]} = 0 THEN CASE WHEN {b['model']} = 0 THEN 0e0 ELSE CAST('-infinity' AS DOUBLE) END ELSE 1e0 - {b['model']} / {b[k]} END)", 4) + f" AS bss_{e}_vs_{k}")
    return ", ".join(out)


@plan("daily_evaluation", S.sql(f"""WITH f AS (SELECT n.*, o.aqi AS observed_aqi, c.clim_severe, c.clim_very_poor, CAST(o.aqi >= 401 AS DOUBLE) AS y_severe, CAST(o.aqi >= 301 AS DOUBLE) AS y_very_poor,
 COALESCE(CAST(t.aqi >= 401 AS DOUBLE), 0) AS pers_severe, COALESCE(CAST(t.aqi >= 301 AS DOUBLE), 0) AS pers_very_poor FROM naive n
 JOIN daily_long o ON o.station = n.station AND o.date = n.target_date AND o.aqi IS NOT NULL LEFT JOIN daily_long t ON t.station = n.station AND t.date = n.date
 JOIN clim_exp c ON c.date = n.date AND c.month = month(n.target_date)),
x AS (SELECT *, CAST(horizon AS VARCHAR) AS hz FROM f UNION ALL SELECT *, 'all' FROM f)
SELECT hz AS horizon, COUNT(*) AS n_forecasts, {S.rnd('CAST(COUNT(*) FILTER (WHERE q10 <= observed_aqi AND observed_aqi <= q90) AS DOUBLE) / COUNT(*)', 4)} AS coverage_80, {_de('severe', 401)}, {_de('very_poor', 301)} FROM x GROUP BY 1""", "clim_exp"))
def daily_evaluation(t):
    return dv.daily_evaluation(dv.with_references(naive_forecasts(t), t.daily_long))


@plan("ridge_evaluation")
def ridge_evaluation(t):
    """The ridge forecasts scored against persistence and expanding climatology."""
    f = durable(daily_forecasts(t).select("station", "date", "horizon", "target_date", "q10", "q90", "p_severe", "p_very_poor"))
    return dv.daily_evaluation(dv.with_references(f, t.daily_long))


def _scored(t):
    rows = dv.experiment_rows(qv.labelled(t))
    by, feats = ["experiment", "event", "horizon"], list(dv.FEATURES)
    weights = lg.fit_logistic(rows.where("part = 'train'"), by, feats, "y")
    return rows, lg.predict_logistic(dv.reference_forecasts(rows), weights, by, feats)


@plan("logistic_event_prob")
def logistic_event_prob(t):
    _, scored = _scored(t)
    return scored.select("experiment", "event", "horizon", "station", _C("date").cast("string").alias("date"), "y", round_half_even(_C("p_model"), 6).alias("p_model"))


@plan("experiment_grid_logistic")
def experiment_grid_logistic(t):
    rows, scored = _scored(t)
    return dv.experiment_grid(rows, scored)


def split_samples(t):
    s = durable(ft.split_by_winter(qf.samples(t), qf.SEASONS[:1], qf.SEASONS[1]))
    return s.where("part = 'train'").drop("part"), s.where("part = 'test'").drop("part")


def calibrated(t):
    """Test rows with the severe probability `p_raw` and `p_calibrated`, fitted on the training rows; and the training base rate."""
    rows = vf.with_exceedance(qv.categories(t).select("station", *qv.SEVERE_COLUMNS)).drop(*BAND_COLUMNS).withColumns({
        "p_raw": round_half_even(_C("p_raw"), 9), "is_severe": vf.severe_state(_C("target_pm25"), _C("target_pm10"))})
    rows = durable(rows)
    cut = F.lit("2024-01-21 00:00:00").cast("timestamp_ntz")
    train = rows.where((_C("issue_time") < cut) & _C("target_pm25").isNotNull() & _C("target_pm10").isNotNull())
    return iso.isotonic_calibrate(train, rows.where(_C("issue_time") >= cut), "p_raw", "is_severe", "p_calibrated"), vf.severe_base_rate(train).first()["base_rate"]


@plan("isotonic_calibration")
def isotonic_calibration(t):
    """Severe probabilities of the test rows, calibrated on the training rows."""
    out, _ = calibrated(t)
    return out.select("station", "issue_time", "lead_h", round_half_even(_C("p_raw"), 6).alias("p_raw"), round_half_even(_C("p_calibrated"), 6).alias("p_calibrated"))


@plan("severe_risk_calibrated")
def severe_risk_calibrated(t):
    """The severe table with the calibrated probability: its Brier score and its skill over climatology and persistence."""
    out, rate = calibrated(t)
    rows = out.withColumns({
        "p_clim": F.lit(rate), "p_pers": vf.severe_state(_C("last_obs_pm25"), _C("last_obs_pm10")), "p_drv": vf.severe_state(_C("driver_pm25"), _C("driver_pm10"))})
    return vf.severe_risk_table(rows, "obs_cat", {**qv._PROBS, "calibrated": "p_calibrated"})


@plan("reliability_calibrated")
def reliability_calibrated(t):
    """Five reliability bins of the raw and of the calibrated severe probability on the test rows."""
    known = calibrated(t)[0].where("obs_cat <> 'Unknown'").withColumn("y", (_C("obs_cat") == "Severe").cast("double"))
    kinds = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), _C(c).alias("p")) for m, c in (("raw", "p_raw"), ("calibrated", "p_calibrated"))]))
    return vf.reliability_5(known.select("y", kinds.alias("k")).select("y", "k.*"), "y", "p", ["model"])


_SAVED: dict[tuple[str, str], str] = {}


def saved_models(t, train):
    """Models of the training season, fitted and saved once per session and input, and loaded again."""
    key = t.spark.sparkContext.applicationId, t.sf_dir
    if key not in _SAVED:
        path = f"{shared_folder(t.spark)}/models-{uuid.uuid4().hex}"
        bo.save_models(t.spark, bo.train_quantile_models(train), {"season": qf.SEASONS[0]}, path)
        _SAVED[key] = path
    return bo.load_models(t.spark, _SAVED[key])[0]


@plan("quantile_gbt")
def quantile_gbt(t):
    """Test-season quantiles of every pollutant from boosted trees, as saved and loaded again."""
    train, test = split_samples(t)
    out = bo.predict_quantiles(saved_models(t, train), test)
    return out.select("station", "issue_time", "lead_h", *[f"{p}_p{q}" for p in POLLUTANTS for q in (10, 50, 90)])


@plan("forecast_72h_boosted")
def forecast_72h_boosted(t):
    """The operational forecast of the test season's daily issues with the saved boosted models."""
    train, _ = split_samples(t)
    issues = ft.issue_times(t.stations, qf.SEASONS[1:], 24)
    return fc.forecast_72h_boosted(t.obs, t.drivers, issues, saved_models(t, train))
