import datetime as dt

import pytest
from pyspark.sql import functions as F

from hazeline.constants import MET_VARIABLES, POLLUTANTS
from hazeline.operators import bands as bd
from hazeline.operators import bias as bs
from hazeline.operators import climatology as cm
from hazeline.operators import features as ft
from hazeline.operators import boosting as bo
from hazeline.plans.forecast import forecast_72h, forecast_72h_boosted, forecast_json

T = dt.datetime(2024, 1, 10)
OBS = "station string, ts timestamp_ntz, pm25 double, pm10 double, o3 double, no2 double"


def obs_frame(spark, rows):
    return spark.createDataFrame(rows, OBS)


def obs_rows(value=lambda h: 150.0, hours=range(-200, 73)):
    return [("s", T + dt.timedelta(hours=h), value(h), 2 * value(h), 30.0, 20.0) for h in hours]


def drivers(spark, hours=range(-200, 73), pm25=100.0):
    rows = [("s", T + dt.timedelta(hours=h), pm25, 200.0, 40.0, 25.0, *[float(i + 1) for i in range(6)]) for h in hours]
    return spark.createDataFrame(rows, "station string, ts timestamp_ntz, pm2_5 double, pm10 double, ozone double, nitrogen_dioxide double, " + ", ".join(f"{m} double" for m in MET_VARIABLES))


@pytest.fixture(scope="module")
def issue(spark):
    return spark.createDataFrame([("s", T)], "station string, issue_time timestamp_ntz")


def test_forecast_shape_order_and_growth(spark, issue):
    out = forecast_72h(obs_frame(spark, obs_rows()), drivers(spark), issue).orderBy("lead_h").collect()
    assert [r["lead_h"] for r in out] == list(range(1, 73))
    for r in out:
        for p in (*POLLUTANTS, "aqi"):
            assert 0 <= r[f"{p}_p10"] <= r[f"{p}_p50"] <= r[f"{p}_p90"]
        assert r["bias_correction"] == "applied" and r["pm25_p50"] == 150.0 and r["recent_obs_count_7d"] == 169
    assert out[0]["newest_obs_age_hours"] == 0.0
    # constant residuals: the floor of 5 widens with the lead
    assert out[71]["pm25_p90"] - 150 == pytest.approx(5 * 1.288, abs=0.06)


def test_fallback_when_recent_observations_are_missing(spark, issue):
    stale = obs_rows(hours=range(-400, -180)) + obs_rows(hours=(-8, -5, -2))
    out = forecast_72h(obs_frame(spark, stale), drivers(spark), issue).orderBy("lead_h").collect()
    first, last = out[0], out[-1]
    assert first["bias_correction"] == "unavailable_no_recent_obs" and first["recent_obs_count_7d"] == 3 and first["newest_obs_age_hours"] == 2.0
    assert first["pm25_p50"] == 100.0
    assert (last["pm25_p90"] - 100) / (first["pm25_p90"] - 100) == pytest.approx(1.288 / 1.004, rel=0.01)


def test_future_observations_change_nothing(spark, issue):
    keep = [c for c in ("lead_h", "pm25_p10", "pm25_p50", "pm25_p90", "o3_p50", "no2_p50", "aqi_p50", "p_severe_24h")]

    def run(rows):
        return sorted(tuple(r) for r in forecast_72h(obs_frame(spark, rows), drivers(spark), issue).select(*keep).collect())

    spoiled = obs_rows(lambda h: 150.0 if h <= 0 else 9999.0)
    assert run(obs_rows()) == run(spoiled)


def test_persistence_window_edges(spark, issue):
    rows = [("s", T - dt.timedelta(hours=24), 7.0, None, None, 3.0), ("s", T - dt.timedelta(hours=25), 1.0, 8.0, None, 1.0), ("s", T + dt.timedelta(hours=1), 99.0, 99.0, 99.0, 99.0)]
    r = ft.persistence_24h(issue, obs_frame(spark, rows)).first()
    assert (r["last_obs_pm25"], r["last_obs_pm10"], r["last_obs_o3"], r["last_obs_no2"]) == (7.0, None, None, 3.0)


def test_issue_times(spark):
    st = spark.createDataFrame([("s",)], "station string")
    got = [r["issue_time"] for r in ft.issue_times(st, [("2024-01-01", "2024-01-05")], 12).orderBy("issue_time").collect()]
    assert got[0] == dt.datetime(2024, 1, 1) and got[-1] == dt.datetime(2024, 1, 2, 12) and len(got) == 4


def test_rolling_bias_and_leads(spark, issue):
    bias = bs.rolling_bias_7d(obs_frame(spark, obs_rows(hours=range(-100, 1))), drivers(spark))
    got = {r["pollutant"]: r["bias_7d"] for r in bs.bias_at_issue(issue, bias).collect()}
    assert got["pm25"] == 50.0 and got["o3"] == -10.0
    early = bias.where("pollutant = 'pm25'").orderBy("ts").limit(6).collect()
    assert [r["bias_7d"] for r in early] == [None] * 5 + [50.0]
    lone = spark.createDataFrame([("other", T)], "station string, issue_time timestamp_ntz")
    assert {r["bias_7d"] for r in bs.bias_at_issue(lone, bias).collect()} == {0.0}


@pytest.mark.parametrize("lead,want", [(12, 80.0), (36, 70.0), (60, 64.0)])
def test_lead_blend(spark, lead, want):
    row = spark.range(1).select(
        bs.lead_blend(F.lit(100.0), F.lit(60.0), "pm25", F.lit(lead)).alias("a"), bs.lead_blend(F.lit(None).cast("double"), F.lit(60.0), "pm25", F.lit(lead)).alias("b"),
        bs.driver_bias_corrected(F.lit(20.0), F.lit(-50.0)).alias("c"), bs.driver_bias_corrected(F.lit(None).cast("double"), F.lit(1.0)).alias("d")).first()
    assert (row["a"], row["b"], row["c"], row["d"]) == (want, 60.0, 0.0, None)


def test_leak_audit_finds_planted_leak(spark):
    st = spark.createDataFrame([("s",)], "station string")
    o = obs_frame(spark, obs_rows(lambda h: float(h + 500)))
    good = ft.samples_72h(o, drivers(spark), st, [("2024-01-08", "2024-01-12")], 24)
    assert ft.leak_audit(good, o).count() == 0
    assert ft.leak_audit(good.withColumn("last_obs_pm25", F.col("target_pm25")), o).count() > 0


def test_climatology_fallback_chain(spark):
    rows = [("s", dt.datetime(2024, 1, d, 5), 10.0 * d, None, None, None) for d in (1, 2, 3)] + [("t", dt.datetime(2024, 2, 1, 7), 99.0, None, None, None)]
    m = cm.climatology_median(obs_frame(spark, rows))
    ask = spark.createDataFrame([("s", dt.datetime(2025, 1, 9, 5), 0), ("s", dt.datetime(2025, 1, 9, 6), 1), ("u", dt.datetime(2025, 2, 9, 7), 2), ("u", dt.datetime(2025, 2, 9, 8), 3), ("u", dt.datetime(2025, 6, 9, 8), 4)],
                                "station string, valid_time timestamp_ntz, k int")
    got = {r["k"]: (r["clim_pm25"], r["clim_o3"]) for r in cm.climatology_lookup(ask, m).collect()}
    assert got == {0: (20.0, 50.0), 1: (20.0, 50.0), 2: (99.0, 50.0), 3: (99.0, 50.0), 4: (25.0, 50.0)}


def test_winter_overlap_is_refused(spark):
    df = spark.createDataFrame([(T,)], "valid_time timestamp_ntz")
    with pytest.raises(ValueError):
        ft.split_by_winter(df, [("2023-10-01", "2024-02-29")], ("2024-02-01", "2024-02-10"))
    with pytest.raises(ValueError):
        ft.split_by_year(df, (2020, 2021), 2021)


def test_json_documents(spark, issue):
    reg = spark.createDataFrame([("s", "S", 1.0, 2.0)], "station string, name string, lat double, lon double")
    import json

    doc = forecast_json(forecast_72h(obs_frame(spark, obs_rows()), drivers(spark), issue), reg).first()
    body = json.loads(doc["document"])
    assert doc["n_hours"] == 72 and [h["lead_h"] for h in body["hourly"]] == list(range(1, 73)) and set(body["p_severe"]) == {"24h", "48h", "72h"}
    assert "NaN" not in doc["document"]


def test_windows_count_what_is_off_the_hour(spark):
    issue = dt.datetime(2024, 1, 10, 12, 20)
    stamps = [issue - dt.timedelta(hours=2 * k, minutes=5) for k in range(84)] + [issue, issue - dt.timedelta(days=7), issue + dt.timedelta(minutes=1), issue - dt.timedelta(days=7, minutes=1)]
    o = spark.createDataFrame([("s", t, 10.0 + k, 1.0, 1.0, 1.0) for k, t in enumerate(stamps)], "station string, ts timestamp_ntz, pm25 double, pm10 double, o3 double, no2 double")
    d = o.select("station", "ts", *[F.lit(5.0).alias(c) for c in ("pm2_5", "pm10", "ozone", "nitrogen_dioxide")])
    i = spark.createDataFrame([("s", issue)], "station string, issue_time timestamp_ntz")
    g = bs.staleness_guard(i, o).first()
    assert (g["recent_obs_count_7d"], g["newest_obs_age_hours"], g["bias_correction"]) == (86, 0.0, "applied")
    r = {x["pollutant"]: x for x in bs.residual_quantiles(i, o, d).collect()}
    assert r["pm25"]["n_pairs"] == 86 and abs(r["pm25"]["res_p50"] - (10 + 42.5 - 5)) < 1e-9


def test_boosted_forecast_scores_without_python(spark, issue):
    seen = spark.createDataFrame([("s", T - dt.timedelta(hours=24 * k)) for k in range(1, 7)], "station string, issue_time timestamp_ntz")
    obs = obs_frame(spark, obs_rows(lambda h: 120.0 + 40 * ((h + 240) % 24) / 24 + h % 7))
    train = ft.samples_for_issues(seen, obs, drivers(spark))
    models = bo.train_quantile_models(train, trees=3)
    out = forecast_72h_boosted(obs, drivers(spark), issue, models)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan and "InPandas" not in plan
    rows = out.orderBy("lead_h").collect()
    assert [r["lead_h"] for r in rows] == list(range(1, 73)) and rows[0]["valid_time"] == T + dt.timedelta(hours=1)
    assert {(r["bias_correction"], r["newest_obs_age_hours"], r["recent_obs_count_7d"]) for r in rows} == {("not_applicable", None, 0)}
    batch = {r["lead_h"]: r for r in bo.predict_quantiles(models, ft.samples_for_issues(issue, obs, drivers(spark))).collect()}
    for r in rows:
        for p in POLLUTANTS:
            assert [r[f"{p}_{q}"] for q in bd.Q] == [pytest.approx(batch[r["lead_h"]][f"{p}_{q}"], abs=0.0500001) for q in bd.Q]
            assert 0 <= r[f"{p}_p10"] <= r[f"{p}_p50"] <= r[f"{p}_p90"]
        assert r["aqi_p10"] <= r["aqi_p50"] <= r["aqi_p90"]
    assert len({r["pm25_p50"] for r in rows}) > 1 and set(out.columns) == set(forecast_72h(obs, drivers(spark), issue).columns)


def test_leads_are_whole_hours_and_exploded_issues_are_not_broadcast(spark):
    off = T + dt.timedelta(minutes=20)
    issues = spark.createDataFrame([("s", T, 1), ("s", off, 2), ("s", off, 3), ("t", T, 4)], "station string, issue_time timestamp_ntz, k int")
    hours = [T + dt.timedelta(hours=h) for h in range(-2, 80) if h != 5] + [off + dt.timedelta(hours=h) for h in (0, 1, 72, 73)]
    d = spark.createDataFrame([("s", t, 1.0) for t in hours], "station string, ts timestamp_ntz, pm2_5 double")
    out = ft.lead_expand(issues, d)
    plan = out._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and dict(out.dtypes)["lead_h"] == "int"
    got = sorted((r["k"], r["lead_h"], r["valid_time"]) for r in out.collect())
    want = [(1, h, T + dt.timedelta(hours=h)) for h in range(1, 73) if h != 5]
    assert got == want + [(k, h, off + dt.timedelta(hours=h)) for k in (2, 3) for h in (1, 72)]


def test_samples_meet_targets_before_the_leads(spark, issue):
    rows = ft.samples_for_issues(issue, obs_frame(spark, obs_rows(hours=range(-200, 40))), drivers(spark))
    plan = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [line for line in plan if " Join " in line]
    assert len(joins) == 2 and "_day" in joins[0] and "LeftOuter" in joins[1]
    got = {r["lead_h"]: r["target_pm25"] for r in rows.collect()}
    assert got == {h: 150.0 if h < 40 else None for h in range(1, 73)}


def test_evaluation_joins_nothing_to_the_expanded_samples(spark, issue):
    from hazeline.plans.verification import evaluation_table

    obs = obs_frame(spark, obs_rows())
    known = issue.withColumn("kept", F.lit("yes"))
    table = evaluation_table(known, obs, drivers(spark), obs)
    plan = table._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert "_day" in next(line for line in plan if " Join " in line)
    rows = table.collect()
    assert sorted(r["lead_h"] for r in rows) == list(range(1, 73))
    assert {(r["kept"], r["bc_pm25"], r["blend_pm25"], r["clim_pm25"], r["target_pm25"]) for r in rows} == {("yes", 150.0, 150.0, 150.0, 150.0)}
