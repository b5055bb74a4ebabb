import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazeline.operators import ordered as od

T0 = dt.datetime(2024, 1, 1)


def skewed(n=4000, seed=1):
    """A third of all rows in one group."""
    r = random.Random(seed)
    return [("hot" if r.random() < 0.34 else f"g{r.randrange(40)}", i, float(r.randrange(50))) for i in range(n)]


def test_running_totals_and_previous(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "g string, o int, v double").repartition(5)
    got = od.place(df, ["g"], ["o"], slots=7).running({"rn": F.lit(1), "s": F.col("v")}).previous({"pv": "v"})
    pdf = got.rows().toPandas().sort_values(["g", "o"]).reset_index(drop=True)
    gb = pdf.groupby("g")
    assert (pdf["rn"] == gb.cumcount() + 1).all()
    assert (pdf["rn_total"] == gb["v"].transform("size")).all()
    assert np.allclose(pdf["s"], gb["v"].cumsum())
    assert (pdf["pv"].fillna(-1) == gb["v"].shift(1).fillna(-1)).all()


def test_hot_group_is_spread(spark):
    df = spark.createDataFrame(skewed(), "g string, o int, v double")
    placed = od.place(df, ["g"], ["o"], slots=8).df
    sizes = [r["count"] for r in placed.groupBy("_slot").count().collect()]
    assert max(sizes) < 4000 * 0.25


def test_exact_percentiles_match_numpy(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "g string, o int, v double")
    got = od.exact_percentiles(df, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.93}).collect()
    pdf = pd.DataFrame(rows, columns=["g", "o", "v"])
    for r in got:
        want = np.percentile(pdf[pdf.g == r["g"]].v, [10, 50, 93])
        assert np.allclose([r["a"], r["b"], r["c"]], want)
    assert len(got) == pdf.g.nunique()


def test_probe_counts(spark):
    rows = skewed(600)
    df = spark.createDataFrame(rows, "g string, o int, v double")
    asks = spark.createDataFrame([(g, x, inc, f"{g}{x}{inc}") for g in ("hot", "g3", "none") for x in (0.0, 10.0, 60.0) for inc in (True, False)],
                                 "g string, x double, inc boolean, id string")
    ranked = od.ranked_values(df, ["g"], "v", probes=asks, probe="x", inclusive="inc")
    for r in od.probe_counts(ranked, ["g"], "x").collect():
        vals = [v for g, _, v in rows if g == r["g"]]
        want = sum(v <= r["x"] for v in vals) if r["inc"] else sum(v < r["x"] for v in vals)
        assert (r["n_below"], r["n_values"]) == (want, len(vals))


def _series(seed, n=200):
    r = random.Random(seed)
    out = []
    for s in ("a", "b"):
        for h in range(n):
            if r.random() < 0.4:
                out.append((s, T0 + dt.timedelta(hours=h), r.random() if r.random() < 0.7 else None, float(h)))
    return out


@pytest.mark.parametrize("hours", [24, 5])
def test_asof_within(spark, hours):
    obs = _series(3)
    left = [(s, T0 + dt.timedelta(hours=h), h) for s in ("a", "b", "c") for h in range(0, 230, 7)]
    got = od.asof_within(
        spark.createDataFrame(left, "s string, ts timestamp_ntz, k int"), spark.createDataFrame(obs, "s string, ts timestamp_ntz, v double, w double"),
        ["s"], "ts", {"v": "v", "w": "w"}, hours * od.HOUR_US).collect()
    assert len(got) == len(left)
    for r in got:
        for i, c in ((2, "v"), (3, "w")):
            seen = [(o[1], o[i]) for o in obs if o[0] == r["s"] and o[i] is not None and r["ts"] - dt.timedelta(hours=hours) <= o[1] <= r["ts"]]
            assert r[c] == (max(seen)[1] if seen else None)


def test_asof_any_age_across_buckets(spark):
    obs = _series(4)
    left = [(s, T0 + dt.timedelta(hours=h), h) for s in ("a", "b", "c") for h in range(-5, 900, 13)]
    got = od.asof_any_age(
        spark.createDataFrame(left, "s string, ts timestamp_ntz, k int"), spark.createDataFrame(obs, "s string, ts timestamp_ntz, v double, w double"),
        ["s"], "ts", {"v": "v"}, bucket_us=50 * od.HOUR_US).collect()
    assert len(got) == len(left)
    for r in got:
        seen = [(o[1], o[2]) for o in obs if o[0] == r["s"] and o[2] is not None and o[1] <= r["ts"]]
        assert r["v"] == (max(seen)[1] if seen else None)


def test_rolling_mean_is_right_closed(spark):
    rows = [("a", T0 + dt.timedelta(hours=h), float(h)) for h in range(0, 400, 3)]
    df = spark.createDataFrame(rows, "s string, ts timestamp_ntz, v double")
    got = od.rolling_mean(df, ["s"], "ts", "v", "m", 168 * od.HOUR_US, 6).collect()
    want = pd.Series([v for _, _, v in rows], index=[t for _, t, _ in rows]).rolling("7D", min_periods=6).mean()
    assert len(got) == len(rows)
    for r in got:
        w = want[r["ts"]]
        assert (r["m"] is None) if np.isnan(w) else abs(r["m"] - w) < 1e-9


def test_previous_time_and_calendar_shift(spark):
    rows = [("a", T0 + dt.timedelta(days=d)) for d in (0, 1, 40, 41, 200)]
    got = od.previous_time(spark.createDataFrame(rows, "s string, ts timestamp_ntz"), ["s"], "ts", "p").collect()
    prev = {r["ts"]: r["p"] for r in got}
    assert [prev[t] for _, t in rows] == [None] + [t for _, t in rows[:-1]]

    days = spark.createDataFrame([("a", dt.date(2021, 12, 30), 420.0), ("a", dt.date(2021, 12, 31), 410.0), ("a", dt.date(2023, 1, 1), 350.0), ("a", dt.date(2023, 1, 2), 450.0)],
                                 "station string, date date, v double")
    out = {r["date"]: (r["lag"], r["lead"]) for r in od.calendar_shift(days, ["station"], "date", "v", {"lag": -1, "lead": 1}).collect()}
    assert out[dt.date(2021, 12, 31)] == (420.0, None)
    assert out[dt.date(2023, 1, 1)] == (None, 450.0)


def test_first_rows(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, o int, v string")
    assert sorted((r["k"], r["v"]) for r in od.first_rows(df, ["k"], ["o"]).collect()) == [("a", "y"), ("b", "z")]
