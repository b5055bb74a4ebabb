"""Registered queries of climatology, verification and daily event forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeline.constants import ALL_LEADS, POLLUTANTS
from hazeline.functions.index import with_pm_aqi
from hazeline.functions.numeric import round_half_even
from hazeline.operators import climatology as cm
from hazeline.operators import daily_verify as dv
from hazeline.operators import features as ft
from hazeline.operators import verify as vf
from hazeline.operators.bands import BAND_COLUMNS, blend_columns, residual_structs
from hazeline.operators.bias import residual_quantiles
from hazeline.plans import adapters as A
from hazeline.plans import q_features as qf
from hazeline.plans import sqltext as S
from hazeline.plans.registry import plan
from hazeline.plans.verification import evaluation_table
from hazeline.session import durable

_C = F.col
TRAIN_END = "2024-01-20 23:00:00"
MODELS = {"persistence": "last_obs_", "raw_driver": "driver_", "rolling_bc": "bc_", "lead_blend": "blend_", "climatology": "clim_", "band_median": "{}_p50"}


def train_obs(t):
    return t.obs.where(_C("ts") <= F.lit(TRAIN_END).cast("timestamp_ntz"))


S.view("train_obs", f"SELECT * FROM obs WHERE ts <= TIMESTAMP '{TRAIN_END}'", "obs")
S.view("train_long", "SELECT * FROM (UNPIVOT (SELECT station, CAST(month(ts) AS INTEGER) AS month, CAST(hour(ts) AS INTEGER) AS hour, pm25, pm10, o3, no2 FROM train_obs) ON pm25, pm10, o3, no2 INTO NAME pollutant VALUE value)", "train_obs")
S.view("medians", """SELECT pollutant, CASE WHEN grouping(station) = 0 AND grouping(month) = 0 AND grouping(hour) = 0 THEN 0
  WHEN grouping(station) = 0 THEN 1 WHEN grouping(hour) = 0 THEN 2 WHEN grouping(month) = 0 THEN 3 ELSE 4 END AS level,
 COALESCE(station, '*') AS station, COALESCE(month, -1) AS month, COALESCE(hour, -1) AS hour, quantile_cont(value, 0.5) AS median, COUNT(*) AS n_values
FROM train_long GROUP BY GROUPING SETS ((pollutant, station, month, hour), (pollutant, station, month), (pollutant, month, hour), (pollutant, month), (pollutant))""", "train_long")


@plan("climatology_median", S.sql(f"SELECT pollutant, level, station, month, hour, {S.rnd('median', 6)} AS median, n_values FROM medians", "medians"))
def climatology_median(t):
    m = cm.climatology_median(train_obs(t))
    return m.withColumns({"median": round_half_even(_C("median"), 6), "n_values": _C("n_values").cast("long")})


def _clim_joins(valid="s.valid_time"):
    sel, joins = [], []
    for p in POLLUTANTS:
        parts = []
        for i, keys in enumerate(cm.LEVELS):
            a = f"c{i}_{p}"
            cond = [f"{a}.pollutant = '{p}'", f"{a}.level = {i}"]
            cond += [f"{a}.station = s.station"] if "station" in keys else []
            cond += [f"{a}.month = month({valid})"] if "month" in keys else []
            cond += [f"{a}.hour = hour({valid})"] if "hour" in keys else []
            joins.append(f"LEFT JOIN medians {a} ON " + " AND ".join(cond))
            parts.append(f"{a}.median")
        sel.append(f"COALESCE({', '.join(parts)}, 50e0) AS clim_{p}")
    return ", ".join(sel), " ".join(joins)


_SEL, _JOINS = _clim_joins()
_R = f"r AS ({qf._pivot_resq('resq')})"
S.view("evaluation", f"""WITH {_R} SELECT s.station, s.issue_time, s.valid_time, s.lead_h, {", ".join(f"s.target_{p}, s.driver_{p}, s.last_obs_{p}, s.bc_{p}, {qf._blend_sql(p, f's.last_obs_{p}', f's.bc_{p}').replace('lead_h', 's.lead_h')} AS blend_{p}" for p in POLLUTANTS)},
 {_SEL}, {", ".join(f"{S.rnd(e, 6)} AS {p}_{q}" for p in POLLUTANTS for q, e in zip(qf._Q, qf._blend_band_sql(p)))}
FROM candidates s LEFT JOIN r ON r.station = s.station AND r.issue_time = s.issue_time {_JOINS}""", "candidates", "medians", "resq")


HELD_OUT = "issue_time >= TIMESTAMP '2024-01-21'"
S.view("held_out", f"SELECT * FROM evaluation WHERE {HELD_OUT}", "evaluation")


def held_out(rows):
    return rows.where(_C("issue_time") >= F.lit("2024-01-21 00:00:00").cast("timestamp_ntz"))


def evaluation(t):
    """All candidates; `band_median` is the middle of the blend bands."""
    o, d, issues = t.obs, t.drivers, qf.issues(t)
    known = issues.join(residual_structs(residual_quantiles(issues, o, d)), ["station", "issue_time"], "left")
    out = blend_columns(evaluation_table(known, o, d, train_obs(t)))
    names = [f"{p}_{q}" for p in POLLUTANTS for q in qf._Q]
    return out.withColumns({n: round_half_even(_C(n), 6) for n in names})


@plan("climatology_lookup", S.sql("SELECT station, issue_time, lead_h, " + ", ".join(f"{S.rnd(f'clim_{p}', 6)} AS clim_{p}" for p in POLLUTANTS) + " FROM evaluation", "evaluation"))
def climatology_lookup(t):
    rows = cm.climatology_lookup(qf.samples(t), cm.climatology_median(train_obs(t)))
    return rows.select("station", "issue_time", "lead_h", *[round_half_even(_C(f"clim_{p}"), 6).alias(f"clim_{p}") for p in POLLUTANTS])


def _metric_cols(err):
    n = f"COUNT({err})"
    return (f"{S.rnd(S.eavg(f'abs({err})'), 2)} AS mae, {S.rnd(f'sqrt({S.eavg(f'({err}) * ({err})')})', 2)} AS rmse, "
            f"{S.rnd(S.eavg(err), 2)} AS bias, {n} AS n")


@plan("continuous_metrics", S.sql(f"SELECT station, {_metric_cols('d.pm2_5 - o.pm25')} FROM (SELECT * FROM obs) o JOIN (SELECT station AS st, ts AS t, pm2_5 FROM drivers) d ON o.station = d.st AND o.ts = d.t GROUP BY station", "obs", "drivers"))
def continuous_metrics(t):
    j = t.obs.select("station", "ts", "pm25").join(t.drivers.select("station", "ts", "pm2_5"), ["station", "ts"])
    return vf.continuous_metrics(j, "pm25", "pm2_5", ["station"])


_BK = "CASE WHEN lead_h <= 24 THEN '1-24h' WHEN lead_h <= 48 THEN '25-48h' ELSE '49-72h' END"
_COLS = {m: (lambda p, c=c: c.format(p) if "{}" in c else c + p) for m, c in MODELS.items()}
_LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT '{p}' AS pollutant, lead_h, '{m}' AS model, target_{p} AS y, {c(p)} AS yhat FROM held_out" for p in POLLUTANTS for m, c in _COLS.items()
) + f"), lb AS (SELECT *, {_BK} AS bucket FROM long UNION ALL SELECT *, '{ALL_LEADS}' FROM long), met AS (SELECT pollutant, bucket, model, {_metric_cols('(yhat - y)')} FROM lb GROUP BY 1, 2, 3)"


@plan("lead_bucket_metrics", S.sql(f"""WITH l AS ({" UNION ALL ".join(f"SELECT '{p}' AS pollutant, lead_h, target_{p} AS y, driver_{p} AS yhat FROM samples" for p in POLLUTANTS)}),
lb AS (SELECT *, {_BK} AS bucket FROM l UNION ALL SELECT *, '{ALL_LEADS}' FROM l) SELECT pollutant, bucket, 'raw_driver' AS model, {_metric_cols('(yhat - y)')} FROM lb GROUP BY 1, 2""", "samples"))
def lead_bucket_metrics(t):
    return vf.candidate_metrics(qf.samples(t), {"raw_driver": "driver_"})


def metrics(t):
    return vf.candidate_metrics(held_out(evaluation(t)), MODELS)


@plan("candidate_metrics", S.sql(f"WITH {_LONG} SELECT * FROM met", "held_out"))
def candidate_metrics(t):
    return metrics(t)


_RANK = "CASE model WHEN 'rolling_bc' THEN 0 WHEN 'lead_blend' THEN 1 WHEN 'band_median' THEN 2 WHEN 'persistence' THEN 3 WHEN 'raw_driver' THEN 4 ELSE 5 END"


@plan("best_model", S.sql(f"WITH {_LONG} SELECT pollutant, bucket, COALESCE(FIRST(model ORDER BY mae, {_RANK}) FILTER (WHERE mae IS NOT NULL), 'None') AS best_model, MIN(mae) AS best_mae FROM met GROUP BY 1, 2", "held_out"))
def best_model(t):
    return vf.best_model(metrics(t))


def _skill(m):
    return f"CASE WHEN raw <> 0 AND {m} <> 0 THEN {S.rnd(f'(1e0 - {m} / raw) * 100e0', 1)} END AS skill_{m}"


@plan("skill_vs_raw", S.sql(f"WITH {_LONG}, w AS (SELECT pollutant, bucket, MAX(mae) FILTER (WHERE model = 'raw_driver') AS raw, "
    + ", ".join(f"MAX(mae) FILTER (WHERE model = '{m}') AS {m}" for m in ("band_median", "rolling_bc", "lead_blend"))
    + f" FROM met GROUP BY 1, 2) SELECT pollutant, bucket, {_skill('band_median')}, {_skill('rolling_bc')}, {_skill('lead_blend')} FROM w", "held_out"))
def skill_vs_raw(t):
    return vf.skill_vs_raw(metrics(t), models=("band_median", "rolling_bc", "lead_blend"))


@plan("interval_coverage", S.sql(f"""SELECT pollutant, bucket, {S.rnd("CAST(COUNT(*) FILTER (WHERE y >= lo AND y <= hi) AS DOUBLE) / COUNT(*) FILTER (WHERE y IS NOT NULL AND lo IS NOT NULL AND hi IS NOT NULL) * 100e0", 2)} AS coverage_pct,
 COUNT(*) FILTER (WHERE y IS NOT NULL AND lo IS NOT NULL AND hi IS NOT NULL) AS n FROM ({" UNION ALL ".join(f"SELECT '{p}' AS pollutant, {_BK} AS bucket, target_{p} AS y, {p}_p10 AS lo, {p}_p90 AS hi FROM held_out" for p in POLLUTANTS)}) GROUP BY 1, 2""", "held_out"))
def interval_coverage(t):
    rows = vf.pollutant_rows(held_out(evaluation(t)), {"lo": "{}_p10", "hi": "{}_p90"})
    return vf.interval_coverage(rows, "target", "lo", "hi", ["pollutant", "bucket"])


_SE = "(p - y) * (p - y)"
_SER = "(ref - y) * (ref - y)"


@plan("brier_score", S.sql(f"SELECT station, {S.eavg(_SE, 9)} AS brier, COUNT(p) AS n FROM outcomes GROUP BY 1", "outcomes"))
def brier_score(t):
    return vf.brier_score(t.outcomes, "y", "p", ["station"])


@plan("brier_skill", S.sql(f"SELECT station, CASE WHEN r = 0 THEN CASE WHEN b = 0 THEN 0e0 ELSE CAST('-infinity' AS DOUBLE) END ELSE 1e0 - b / r END AS skill FROM (SELECT station, {S.eavg(_SE, 9)} AS b, {S.eavg(_SER, 9)} AS r FROM outcomes GROUP BY 1)", "outcomes"))
def brier_skill(t):
    o = t.outcomes
    j = vf.brier_score(o, "y", "p", ["station"]).join(vf.brier_score(o, "y", "ref", ["station"]).select("station", _C("brier").alias("r")), "station")
    return j.select("station", vf.brier_skill(_C("brier"), _C("r")).alias("skill"))


def _bins(p, n, op):
    return "(" + " + ".join(f"CASE WHEN {p} {op} {S.num(e)} THEN 1 ELSE 0 END" for e in vf._edges(n)) + ")"


@plan("reliability_5", S.sql(f"SELECT station, CAST({_bins('p', 5, '>=')} AS INTEGER) AS bin, COUNT(*) AS n, {S.rnd(S.eavg('p', 9), 4)} AS mean_predicted, {S.rnd(S.eavg('y', 9), 4)} AS observed_fraction FROM outcomes WHERE p >= 0 AND p <= 1 GROUP BY 1, 2", "outcomes"))
def reliability_5(t):
    return vf.reliability_5(t.outcomes, "y", "p", ["station"])


@plan("reliability_curve", S.sql(f"""WITH e AS (SELECT l_suppkey AS g, SUM(CASE WHEN l_returnflag = 'R' AND l_tax > 0.07 THEN 1 ELSE 0 END) AS ev FROM lineitem GROUP BY 1),
o AS (SELECT l_suppkey AS g, CASE WHEN l_returnflag = 'R' AND l_tax > 0.07 THEN 1e0 ELSE 0e0 END AS y, l_discount * 10 AS p FROM lineitem),
j AS (SELECT o.*, CASE WHEN ev < 10 THEN 5 ELSE 10 END AS n_bins FROM o JOIN e USING (g)),
b AS (SELECT *, CASE WHEN n_bins = 5 THEN {_bins('p', 5, '>')} ELSE {_bins('p', 10, '>')} END AS rb, CASE WHEN n_bins = 5 THEN {_bins('p', 5, '>=')} ELSE {_bins('p', 10, '>=')} END AS lb FROM j),
h AS (SELECT g, lb AS bin, COUNT(*) AS n_hist FROM b GROUP BY 1, 2),
c AS (SELECT g, n_bins, rb AS bin, COUNT(*) AS n_curve, {S.rnd(S.eavg('p', 9), 6)} AS mean_predicted, {S.rnd(S.eavg('y', 9), 6)} AS observed_fraction FROM b GROUP BY 1, 2, 3)
SELECT c.g, c.n_bins, CAST(c.bin AS INTEGER) AS bin, n_curve, COALESCE(n_hist, 0) AS n_hist, mean_predicted, observed_fraction FROM c LEFT JOIN h ON h.g = c.g AND h.bin = c.bin""", "outcomes"))
def reliability_curve(t):
    li = A.table(t.spark, t.sf_dir, "lineitem")
    o = li.select(_C("l_suppkey").alias("g"), F.when((_C("l_returnflag") == "R") & (_C("l_tax") > 0.07), 1.0).otherwise(0.0).alias("y"), (_C("l_discount") * 10).alias("p"))
    return vf.reliability_curve(o, "y", "p", ["g"])


_CAT = {"band_median": ("pm25_p50", "pm10_p50"), "raw_driver": ("driver_pm25", "driver_pm10"), "persistence": ("last_obs_pm25", "last_obs_pm10"),
        "climatology": ("clim_pm25", "clim_pm10"), "rolling_bc": ("bc_pm25", "bc_pm10"), "lead_blend": ("blend_pm25", "blend_pm10")}


def _cat_sql(a, b):
    return S.category("(" + S.pm_index(a, b) + ")")


S.view("categories", f"SELECT issue_time, lead_h, {_cat_sql('target_pm25', 'target_pm10')} AS obs_cat, " + ", ".join(f"{_cat_sql(a, b)} AS cat_{m}" for m, (a, b) in _CAT.items())
    + ", target_pm25, target_pm10, last_obs_pm25, last_obs_pm10, driver_pm25, driver_pm10, pm25_p10, pm25_p50, pm25_p90, pm10_p10, pm10_p50, pm10_p90 FROM evaluation", "evaluation")


def categories(t):
    rows = evaluation(t)
    rows = with_pm_aqi(rows, {"obs": ("target_pm25", "target_pm10")}, None, "{}_cat")
    return with_pm_aqi(rows, _CAT, None, "cat_{}")


_ACC = " UNION ALL ".join(
    f"""SELECT bucket, '{m}' AS model, COUNT(*) AS valid_hours, COALESCE({S.rnd(f"CAST(COUNT(*) FILTER (WHERE {ok} AND r_{m} = r_obs) AS DOUBLE) / NULLIF(COUNT(*) FILTER (WHERE {ok}), 0) * 100e0", 2)}, 0) AS exact_pct,
 COALESCE({S.rnd(f"CAST(COUNT(*) FILTER (WHERE {ok} AND abs(r_{m} - r_obs) <= 1) AS DOUBLE) / NULLIF(COUNT(*) FILTER (WHERE {ok}), 0) * 100e0", 2)}, 0) AS within_one_pct FROM x GROUP BY 1"""
    for m in _CAT for ok in [f"cat_{m} <> 'Unknown'" if m == "persistence" else "TRUE"])


@plan("category_accuracy", S.sql(f"WITH k AS (SELECT *, {S.rank('obs_cat')} AS r_obs, " + ", ".join(f"{S.rank(f'cat_{m}')} AS r_{m}" for m in _CAT)
    + f" FROM categories WHERE obs_cat <> 'Unknown' AND {HELD_OUT}), x AS (SELECT *, {_BK} AS bucket FROM k UNION ALL SELECT *, '{ALL_LEADS}' FROM k) {_ACC}", "categories"))
def category_accuracy(t):
    return vf.category_accuracy(held_out(categories(t)), "obs_cat", {m: f"cat_{m}" for m in _CAT})


def _erfc_sql(x):
    """The same Horner chain as `erfc`, as SQL text (x must be a short column name)."""
    from hazeline.functions.numeric import ERFC_COEFFICIENTS as E

    u = f"(2e0 * (2e0 / (2e0 + abs({x}))) - 1e0)"
    poly = S.num(E[-1])
    for c in reversed(E[:-1]):
        poly = f"({poly} * {u} + {S.num(c)})"
    tail = f"(2e0 / (2e0 + abs({x}))) * exp(-abs({x}) * abs({x}) + {poly})"
    return f"CASE WHEN {x} >= 0 THEN {tail} ELSE 2e0 - {tail} END"


def _z_sql(p, t):
    return f"({S.num(t)} - {p}_p50) / greatest(5e0, ({p}_p90 - {p}_p10) / 2.563e0) / {S.num(2 ** 0.5)}"


_PROB = f"zz AS (SELECT *, {_z_sql('pm25', 251)} AS z25, {_z_sql('pm10', 431)} AS z10 FROM categories), pr AS (SELECT *, {S.rnd(f'greatest(0.5e0 * ({_erfc_sql('z25')}), 0.5e0 * ({_erfc_sql('z10')}))', 9)} AS p_raw FROM zz)"


@plan("p_exceed_gauss", S.sql(f"WITH z AS (SELECT station, issue_time, lead_h, {_z_sql('pm25', 251)} AS z25, {_z_sql('pm10', 431)} AS z10 FROM evaluation) SELECT station, issue_time, lead_h, {S.rnd(f'greatest(0.5e0 * ({_erfc_sql('z25')}), 0.5e0 * ({_erfc_sql('z10')}))', 9)} AS p_severe FROM z", "evaluation"))
def p_exceed_gauss(t):
    rows = vf.with_exceedance(evaluation(t), "p_severe")
    return rows.select("station", "issue_time", "lead_h", round_half_even(_C("p_severe"), 9).alias("p_severe"))


def _sev(a, b):
    return f"CASE WHEN COALESCE({a} >= 251, FALSE) OR COALESCE({b} >= 431, FALSE) THEN 1e0 ELSE 0e0 END"


@plan("severe_base_rate", S.sql(f"SELECT {S.eavg(_sev('target_pm25', 'target_pm10'), 9)} AS base_rate, COUNT(*) AS n_train FROM samples WHERE issue_time < TIMESTAMP '2024-01-21' AND target_pm25 IS NOT NULL AND target_pm10 IS NOT NULL", "samples"))
def severe_base_rate(t):
    return vf.severe_base_rate(qf.samples(t).where(_C("issue_time") < F.lit("2024-01-21 00:00:00").cast("timestamp_ntz")))


def _brier_cols(probs):
    b = {m: f"COALESCE({S.eavg(f'({c} - y) * ({c} - y)', 9)}, 0)" for m, c in probs.items()}
    out = ", ".join(f"{S.rnd(e, 4)} AS brier_{m}" for m, e in b.items())
    for r in ("climatology", "persistence"):
        out += f", {S.rnd(f'(CASE WHEN {b[r]} = 0 THEN CASE WHEN {b["raw"]} = 0 THEN 0e0 ELSE CAST({chr(39)}-infinity{chr(39)} AS DOUBLE) END ELSE 1e0 - {b["raw"]} / {b[r]} END)', 4)} AS bss_raw_vs_{r}"
    return out


#: What the severe tables and the calibration read of the evaluation; the rest is not written.
SEVERE_COLUMNS = ["issue_time", "lead_h", "obs_cat", *[f"{kind}_{p}" for kind in ("target", "last_obs", "driver") for p in ("pm25", "pm10")],
                  *BAND_COLUMNS]
_PROBS = {"raw": "p_raw", "persistence": "p_pers", "raw_driver": "p_drv", "climatology": "p_clim"}


@plan("severe_risk_table", S.sql(f"""WITH {_PROB}, base AS (SELECT {S.eavg(_sev('target_pm25', 'target_pm10'), 9)} AS rate FROM categories WHERE NOT {HELD_OUT} AND target_pm25 IS NOT NULL AND target_pm10 IS NOT NULL),
k AS (SELECT lead_h, CASE WHEN obs_cat = 'Severe' THEN 1e0 ELSE 0e0 END AS y, p_raw, {_sev('last_obs_pm25', 'last_obs_pm10')} AS p_pers, {_sev('driver_pm25', 'driver_pm10')} AS p_drv, rate AS p_clim FROM pr, base WHERE obs_cat <> 'Unknown' AND {HELD_OUT}),
x AS (SELECT *, {_BK} AS bucket FROM k UNION ALL SELECT *, '{ALL_LEADS}' FROM k)
SELECT bucket, COUNT(*) AS n_samples, CAST(SUM(y) AS BIGINT) AS events, {_brier_cols(_PROBS)} FROM x GROUP BY 1""", "categories"))
def severe_risk_table(t):
    rows = durable(categories(t).select(*SEVERE_COLUMNS))
    cut = F.lit("2024-01-21 00:00:00").cast("timestamp_ntz")
    rate = vf.severe_base_rate(rows.where(_C("issue_time") < cut)).first()["base_rate"]
    rows = vf.with_exceedance(held_out(rows)).withColumns({
        "p_raw": round_half_even(_C("p_raw"), 9), "p_clim": F.lit(rate),
        "p_pers": vf.severe_state(_C("last_obs_pm25"), _C("last_obs_pm10")), "p_drv": vf.severe_state(_C("driver_pm25"), _C("driver_pm10")),
    })
    return vf.severe_risk_table(rows, "obs_cat", _PROBS)


# --- daily events

def labelled(t):
    return ft.split_by_year(ft.horizon_labels(t.daily_long), (1996, 1998), 2000)


_GRID = """lab AS (SELECT *, CASE WHEN year IN (1996, 1998) THEN 'train' ELSE 'test' END AS part FROM labels_daily
  WHERE month IN (10, 11, 12, 1, 2) AND year IN (1996, 1998, 2000) AND aqi_t IS NOT NULL AND aqi_t_minus_1 IS NOT NULL),
l0 AS (""" + " UNION ALL ".join(f"SELECT part, station, date, month, aqi_t, '{e}' AS event, {S.num(v)} AS threshold, {h} AS horizon, y_{e}_h{h} AS y FROM lab" for h, e, v in qf._LABELS) + """),
l1 AS (SELECT *, station AS experiment FROM l0 WHERE y IS NOT NULL UNION ALL SELECT *, 'pooled' FROM l0 WHERE y IS NOT NULL),
mo AS (SELECT experiment, event, horizon, month, AVG(y) AS rate FROM l1 WHERE part = 'train' GROUP BY 1, 2, 3, 4),
al AS (SELECT experiment, event, horizon, AVG(y) AS rate FROM l1 WHERE part = 'train' GROUP BY 1, 2, 3),
sc AS (SELECT t.*, COALESCE(mo.rate, al.rate, 0e0) AS p_clim, CAST(aqi_t >= threshold AS DOUBLE) AS p_pers FROM l1 t
  LEFT JOIN mo ON mo.experiment = t.experiment AND mo.event = t.event AND mo.horizon = t.horizon AND mo.month = t.month
  LEFT JOIN al ON al.experiment = t.experiment AND al.event = t.event AND al.horizon = t.horizon WHERE part = 'test')"""


@plan("climatology_rate", S.sql(f"WITH {_GRID} SELECT experiment, event, horizon, station, CAST(date AS VARCHAR) AS date, y, {S.rnd('p_clim', 9)} AS p_clim, p_pers FROM sc", "labels_daily"))
def climatology_rate(t):
    r = dv.reference_forecasts(dv.experiment_rows(labelled(t)))
    return r.select("experiment", "event", "horizon", "station", _C("date").cast("string").alias("date"), "y", round_half_even(_C("p_clim"), 9).alias("p_clim"), "p_pers")


@plan("persistence_event", S.sql("""SELECT station, CAST(date AS VARCHAR) AS date, CASE WHEN p IS NULL THEN NULL ELSE CAST(p >= 301 AS DOUBLE) END AS strict,
 COALESCE(CAST(p >= 301 AS DOUBLE), 0e0) AS filled FROM (SELECT station, date, aqi_t_minus_1 AS p FROM labels_daily)""", "labels_daily"))
def persistence_event(t):
    lag = ft.calendar_lag(t.daily_long)
    return lag.select("station", _C("date").cast("string").alias("date"), cm.persistence_event(_C("aqi_lag"), 301.0).alias("strict"), cm.persistence_event(_C("aqi_lag"), 301.0, 0.0).alias("filled"))


@plan("experiment_grid", S.sql(f"""WITH {_GRID}, cnt AS (SELECT experiment, event, horizon, COUNT(*) FILTER (WHERE part = 'train') AS n_tr, COUNT(*) FILTER (WHERE part = 'test') AS test_days,
  CAST(SUM(CASE WHEN part = 'test' THEN y ELSE 0 END) AS BIGINT) AS events FROM l1 GROUP BY 1, 2, 3),
br AS (SELECT experiment, event, horizon, {S.eavg('(p_clim - y) * (p_clim - y)', 9)} AS b_clim, {S.eavg('(p_pers - y) * (p_pers - y)', 9)} AS b_pers FROM sc GROUP BY 1, 2, 3)
SELECT c.experiment, c.event, c.horizon, CASE WHEN test_days = 0 OR n_tr = 0 THEN 'no data' WHEN events < 10 THEN 'insufficient events' ELSE 'valid' END AS status, test_days, events,
 CASE WHEN test_days > 0 AND n_tr > 0 THEN {S.rnd('b_clim', 5)} END AS brier_clim, CASE WHEN test_days > 0 AND n_tr > 0 THEN {S.rnd('b_pers', 5)} END AS brier_pers,
 CASE WHEN test_days > 0 AND n_tr > 0 THEN {S.rnd("(CASE WHEN b_clim = 0 THEN CASE WHEN b_pers = 0 THEN 0e0 ELSE CAST('-infinity' AS DOUBLE) END ELSE 1e0 - b_pers / b_clim END)", 4)} END AS bss_pers_vs_clim
FROM cnt c LEFT JOIN br USING (experiment, event, horizon)""", "labels_daily"))
def experiment_grid(t):
    return dv.experiment_grid(dv.experiment_rows(labelled(t)))


def _draw_sql(rep, pos, nb, seed=42):
    x = f"(({rep} * 1000003 + {pos} * 7919 + {seed * 104729}) % 2147483647)"
    for _ in range(3):
        x = f"(({x} * 48271 + 11) % 2147483647)"
        x = f"(({x} + ({x} // 65536) * 31) % 2147483647)"
    return f"({x} % {nb})"


def _boot_sql(src, by):
    """Plain resampling: lay the drawn blocks' rows end to end and cut to n rows."""
    b = ", ".join(by)
    return f"""src AS ({src}), rn AS (SELECT *, row_number() OVER (PARTITION BY {b} ORDER BY o1, o2, o3) - 1 AS i, COUNT(*) OVER (PARTITION BY {b}) AS n FROM src),
bl AS (SELECT {b}, i // 7 AS blk, i % 7 AS at, n, CAST(ceil(n / 7.0) AS BIGINT) AS nb, {S.fixed('(p - y) * (p - y)', 9)} AS em, {S.fixed('(ref - y) * (ref - y)', 9)} AS er FROM rn),
g AS (SELECT DISTINCT {b}, n, nb FROM bl),
ps AS (SELECT g.*, r AS rep, q AS pos FROM g, range(0, 1000) t(r), LATERAL (SELECT unnest(range(0, g.nb)) AS q)),
dr AS (SELECT *, {_draw_sql('rep', 'pos', 'nb')} AS blk FROM ps),
ch AS (SELECT dr.{', dr.'.join(by)}, dr.rep, dr.n, bl.em, bl.er, row_number() OVER (PARTITION BY dr.{', dr.'.join(by)}, dr.rep ORDER BY dr.pos, bl.at) AS k
  FROM dr JOIN bl ON {' AND '.join(f'bl.{c} = dr.{c}' for c in by)} AND bl.blk = dr.blk),
rp AS (SELECT {b}, rep, CAST(SUM(em) AS DOUBLE) / 1e9 / COUNT(*) AS brier, CAST(SUM(er) AS DOUBLE) / 1e9 / COUNT(*) AS brier_ref FROM ch WHERE k <= n GROUP BY {b}, rep)"""


_BOOT_SRC = "SELECT experiment, event, horizon, y, p_clim AS p, p_pers AS ref, station AS o1, date AS o2, 0 AS o3 FROM sc"
_BY = ("experiment", "event", "horizon")


def _boot(t, ref=None):
    rows = dv.reference_forecasts(dv.experiment_rows(labelled(t)))
    return vf.block_bootstrap(rows, list(_BY), ["station", "date"], "y", "p_clim", ref)


@plan("bootstrap_brier", S.sql(f"WITH {_GRID}, {_boot_sql(_BOOT_SRC, _BY)} SELECT experiment, event, horizon, {S.rnd('quantile_cont(brier, 0.025)', 6)} AS brier_lo, {S.rnd('quantile_cont(brier, 0.975)', 6)} AS brier_hi FROM rp GROUP BY ALL", "labels_daily"))
def bootstrap_brier(t):
    """Interval per station and pooled experiment, as in the experiment runner."""
    ci = vf.bootstrap_interval(_boot(t), list(_BY), ["brier"])
    return ci.withColumns({c: round_half_even(_C(c), 6) for c in ("brier_lo", "brier_hi")})


_BSS = "CASE WHEN brier_ref = brier THEN 0e0 WHEN brier_ref = 0 THEN CASE WHEN brier = 0 THEN 0e0 ELSE CAST('-infinity' AS DOUBLE) END ELSE 1e0 - brier / brier_ref END"


@plan("bootstrap_skill", S.sql(f"WITH {_GRID}, {_boot_sql(_BOOT_SRC, _BY)}, s AS (SELECT *, {_BSS} AS skill FROM rp) SELECT experiment, event, horizon, {S.rnd('quantile_cont(skill, 0.025)', 6)} AS skill_lo, {S.rnd('quantile_cont(skill, 0.975)', 6)} AS skill_hi FROM s GROUP BY ALL", "labels_daily"))
def bootstrap_skill(t):
    ci = vf.bootstrap_interval(_boot(t, "p_pers"), list(_BY), ["skill"])
    return ci.withColumns({c: round_half_even(_C(c), 6) for c in ("skill_lo", "skill_hi")})
