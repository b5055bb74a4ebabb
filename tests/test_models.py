import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from hazeline.constants import CATEGORIES, DAILY_FEATURES
from hazeline.operators import boosting as bo
from hazeline.operators import features as ft
from hazeline.operators import isotonic as iso
from hazeline.operators import logistic as lg
from hazeline.operators import ridge as rg


def daily_rows(days=60, gap=(20,)):
    r = random.Random(3)
    rows = []
    for s in ("x", "y"):
        for d in range(days):
            if d not in gap:
                a = 250 + 120 * np.sin(d / 6) + r.uniform(-30, 30)
                rows.append((s, dt.date(2024, 10, 1) + dt.timedelta(days=d), float(a), float(a * 0.5 + r.random()), float(a * 0.9), 2024))
    return rows


def brute(rows, d, h):
    data = {(s, t): (a, p25, p10) for s, t, a, p25, p10, _ in rows}

    def feats(s, t):
        week = [data.get((s, t - dt.timedelta(days=k))) for k in range(7)]
        if any(w is None for w in week):
            return None
        a, p25, p10 = week[0]
        return [a, week[1][0], np.mean([w[0] for w in week]), p10 / p25, np.sin(2 * np.pi * t.month / 12), np.cos(2 * np.pi * t.month / 12)]

    X, Y = [], []
    for s, t in data:
        g = t + dt.timedelta(days=h)
        f = feats(s, t)
        if g <= d and f and (s, g) in data:
            X.append(f)
            Y.append(np.log(data[(s, g)][0]))
    X, Y = np.array(X), np.array(Y)
    mu, sd = X.mean(0), X.std(0, ddof=1)
    sd[sd < 1e-9] = 1
    Z = (X - mu) / sd
    beta = np.linalg.solve(Z.T @ Z + np.eye(6), Z.T @ (Y - Y.mean()))
    return len(X), Y.mean(), beta, Y - Y.mean() - Z @ beta, lambda s: Y.mean() + ((np.array(feats(s, d)) - mu) / sd) @ beta


def test_ridge_and_distribution_match_direct_fit(spark):
    rows = daily_rows()
    daily = spark.createDataFrame(rows, "station string, date date, aqi double, pm25 double, pm10 double, season int")
    feats = ft.daily_features(daily).withColumn("season", F.lit(2024))
    got = {(r["date"], r["horizon"], r["station"]): r for r in rg.daily_forecasts(feats, daily).collect()}
    for d, h in ((dt.date(2024, 11, 8), 1), (dt.date(2024, 11, 20), 3)):
        n, b0, beta, res, point = brute(rows, d, h)
        r = got[(d, h, "x")]
        assert r["n_train"] == n
        assert np.isclose(r["intercept"], b0) and np.allclose(r["beta"], beta, atol=1e-5)
        p = point("x")
        assert np.isclose(r["point"], p, atol=1e-6)
        sample = np.exp(p + res)
        assert abs(r["q10"] - np.percentile(sample, 10)) < 0.06 and abs(r["q90"] - np.percentile(sample, 90)) < 0.06
        assert abs(r["p_severe"] - np.mean(sample >= 401)) < 1e-4
        assert abs(sum(r["category_probabilities"].values()) - 1) < 1e-3
        assert set(r["category_probabilities"]) == set(CATEGORIES)
        top = [t["contribution"] for t in r["top_reasons"]]
        assert [abs(t) for t in top] == sorted((abs(t) for t in top), reverse=True) and len(top) == 3
        assert np.isclose(r["intercept"] + sum(r["contributions"]), r["point"])
    assert min(r["n_train"] for r in got.values()) >= 30


def test_distribution_is_the_same_from_runs_in_chunks_and_slices(spark, monkeypatch):
    rows = daily_rows() + [("z", t, 300.0, 150.0, 270.0, 2024) for t in (dt.date(2024, 10, 1) + dt.timedelta(days=d) for d in range(60))]  # equal days
    daily = spark.createDataFrame(rows, "station string, date date, aqi double, pm25 double, pm10 double, season int")
    feats = ft.daily_features(daily).withColumn("season", F.lit(2024))
    train = rg.expanding_train(feats, daily).cache()
    as_of = daily.select("season", "date").distinct().withColumn("horizon", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    coefficients = rg.ridge_expanding(rg.expanding_moments(train, as_of)).cache()
    fit = train.withColumnRenamed("date", "day").join(coefficients, ["season", "horizon"]).where("target_date <= date")
    parts = [F.col("beta")[i] * ((F.col(n) - F.col("mu")[i]) / F.col("sigma")[i]) for i, n in enumerate(DAILY_FEATURES)]
    plain = fit.select("season", "horizon", "date", (F.col("y") - (F.col("intercept") + sum(parts, F.lit(0.0)))).alias("residual"))
    points = rg.predict_points(feats, coefficients)
    names = ["station", "date", "horizon", "n_residuals", "q10", "q90", "p_severe", "p_very_poor", *[f"category_probabilities['{c}']" for c in CATEGORIES]]

    def table(df):
        return sorted(tuple(r) for r in df.selectExpr(*names).collect())

    want = table(rg.predictive_distribution(points, plain, ["season", "horizon", "date"]))
    for chunk, cut in ((rg.CHUNK, rg.SLICE), (50, 30)):  # one task a season and horizon; several chunks of rows and slices of values
        monkeypatch.setattr(rg, "CHUNK", chunk)
        monkeypatch.setattr(rg, "SLICE", cut)
        bounds = rg.residual_bounds(train, coefficients).cache()
        runs = rg.training_residuals(train, coefficients, bounds).cache()
        assert runs.agg(F.sum("n")).first()[0] == plain.count()
        assert runs.agg(F.max("slice")).first()[0] > 2 if cut == 30 else runs.count() == coefficients.count()
        assert want and table(rg.distribution_of_runs(points, runs, bounds)) == want


def test_future_rows_do_not_change_a_forecast(spark):
    rows = daily_rows()
    cut = dt.date(2024, 11, 10)
    spoiled = [(s, t, a if t <= cut else 9.0, b, c, y) for s, t, a, b, c, y in rows]

    def forecasts(data):
        daily = spark.createDataFrame(data, "station string, date date, aqi double, pm25 double, pm10 double, season int")
        f = rg.daily_forecasts(ft.daily_features(daily).withColumn("season", F.lit(2024)), daily)
        return sorted(tuple(r) for r in f.where(F.col("date") == F.lit(cut)).select("station", "horizon", "point", "q10", "q90").collect())

    a = forecasts(rows)
    assert a and a == forecasts(spoiled)


def test_grouped_logistic_matches_spark_ml(spark):
    rng = np.random.RandomState(1)
    rows = []
    for g in ("a", "b"):
        x = rng.normal(size=(300, 2)) * [100, 1] + [250, 0]
        p = 1 / (1 + np.exp(-(0.02 * (x[:, 0] - 250) + (1 if g == "a" else -1) * x[:, 1])))
        rows += [(g, float(u), float(v), float(rng.rand() < q)) for (u, v), q in zip(x, p)]
    rows += [("c", 1.0, 2.0, 1.0), ("c", 2.0, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, u double, v double, y double")
    w = lg.fit_logistic(df, ["g"], ["u", "v"], "y")
    got = lg.predict_logistic(df, w, ["g"], ["u", "v"])
    assert {r["p_model"] for r in got.where("g = 'c'").collect()} == {1.0}
    for g in ("a", "b"):
        part = VectorAssembler(inputCols=["u", "v"], outputCol="x").transform(df.where(F.col("g") == g))
        m = LogisticRegression(featuresCol="x", labelCol="y", regParam=1 / 300, elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-12).fit(part)
        ml = {(r["u"], r["v"]): r["probability"][1] for r in m.transform(part).collect()}
        assert max(abs(r["p_model"] - ml[(r["u"], r["v"])]) for r in got.where(F.col("g") == g).collect()) < 1e-4


def boost_rows(spark):
    rng = np.random.RandomState(2)
    rows = [(float(a), float(50 + 100 * (a > 0.5) + rng.normal() * 5)) for a in rng.rand(600)]
    rows += [(None, 300.0 + i % 7) for i in range(60)] + [(0.5, None)]
    return spark.createDataFrame(rows, "a double, y double")


def test_quantile_boost_learns_and_reloads(spark, tmp_path):
    df = boost_rows(spark)
    model = bo.fit_quantiles(df, ["a"], [("y", 0.1), ("y", 0.5), ("y", 0.9)], trees=8, rate=0.5, leaves=4, cut_every=3)
    got = model.transform(df, ["lo", "mid", "hi"])
    err = got.where("a IS NOT NULL").select(F.avg(F.abs(F.col("mid") - F.col("y")))).first()[0]
    assert err < 10
    assert got.where("a IS NULL").select(F.max(F.abs(F.col("mid") - F.col("y")))).first()[0] < 10
    inside = got.where("y IS NOT NULL").select(F.avg(((F.col("y") >= F.col("lo")) & (F.col("y") <= F.col("hi"))).cast("double"))).first()[0]
    assert 0.7 < inside < 0.95
    bo.save_models(spark, model, {"season": 1}, str(tmp_path / "m"))
    again, meta = bo.load_models(spark, str(tmp_path / "m"))
    assert meta["season"] == 1
    assert [tuple(r) for r in again.transform(df, ["lo", "mid", "hi"]).collect()] == [tuple(r) for r in got.collect()]


def test_quantile_boost_does_not_depend_on_partitions(spark):
    df = boost_rows(spark)
    fits = [bo.fit_quantiles(df.repartition(n), ["a"], [("y", 0.5)], trees=2, leaves=4) for n in (1, 5)]
    assert fits[0].base == fits[1].base
    assert all((x.feature == y.feature).all() and (x.bins == y.bins).all() for a, b in zip(*[f.rounds for f in fits]) for x, y in zip(a, b))


def test_quantile_boost_of_no_rows(spark):
    df = boost_rows(spark)
    model = bo.fit_quantiles(df.limit(0), ["a"], [("y", 0.5)], trees=1)
    assert {r["p"] for r in model.transform(df, ["p"]).collect()} == {0.0}


def test_isotonic_is_monotone_and_clipped(spark):
    train = spark.createDataFrame([(0.1, 0.0), (0.2, 1.0), (0.4, 0.0), (0.4, 1.0), (0.9, 1.0)], "p double, y double")
    test = spark.createDataFrame([(-0.5,), (0.15,), (0.3,), (0.4,), (1.5,)], "p double")
    got = [r["c"] for r in iso.isotonic_calibrate(train, test, "p", "y", "c").orderBy("p").collect()]
    assert got == sorted(got) and 0 <= got[0] and got[-1] <= 1 and got[0] == 0.0 and got[-1] == 1.0


def test_isotonic_equals_the_plain_fit_over_many_tasks(spark):
    rng = random.Random(8)
    rows = [(p, float(rng.random() < 0.2 + 0.6 * p)) for p in (round(rng.random(), 3) for _ in range(3000))]
    x = sorted({p for p, _ in rows})
    total = np.cumsum([0.0] + [sum(y for p, y in rows if p == v) for v in x])
    count = np.cumsum([0.0] + [sum(1 for p, _ in rows if p == v) for v in x])
    n = len(x)
    mean = (total[None, 1:] - total[:-1, None]) / np.where(count[None, 1:] > count[:-1, None], count[None, 1:] - count[:-1, None], np.nan)
    want = [np.nanmax([np.nanmin(mean[a, i:]) for a in range(i + 1)]) for i in range(n)]  # largest of the smallest means around i
    train = spark.createDataFrame(rows + [(None, 1.0), (0.5, None), (float("nan"), 1.0)], "p double, y double").repartition(7)
    ask = x + [(a + b) / 2 for a, b in zip(x, x[1:])] + [-1.0, 2.0]
    test = spark.createDataFrame([(v,) for v in ask] + [(None,), (0.5,)], "p double")
    rows = iso.isotonic_calibrate(train, test, "p", "y", "c").collect()
    got = {r["p"]: r["c"] for r in rows}
    assert len(rows) == len(ask) + 2 and got[None] is None
    for v in ask:
        assert abs(got[v] - np.interp(v, x, want)) < 1e-9, v
    assert {r["c"] for r in iso.isotonic_calibrate(train.limit(0), test, "p", "y", "c").collect()} == {None}
    assert iso.isotonic_calibrate(train, test.limit(0), "p", "y", "c").count() == 0


def plain_best_first(x, sign, alpha, leaves, least, depth):
    """Splits (rows, feature, cut) in best-first order, on rows of bins."""
    def best(rows):
        found = (-1.0, 0, 0)
        for f in range(x.shape[1]):
            for cut in range(int(x.max()) + 1):
                left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                if min(len(left), len(right)) >= least:
                    g = [np.where(sign[r], alpha, alpha - 1).sum() for r in (left, right, rows)]
                    gain = g[0] ** 2 / len(left) + g[1] ** 2 / len(right) - g[2] ** 2 / len(rows)
                    if gain > found[0] + 1e-9:
                        found = (gain, f, cut)
        return found

    open_, out = [(best(np.arange(len(x))), np.arange(len(x)), 0)], []
    while open_ and len(out) < leaves - 1:
        k = max(range(len(open_)), key=lambda i: open_[i][0][0])
        (gain, f, cut), rows, deep = open_.pop(k)
        if gain <= 0:
            break
        out.append((frozenset(rows.tolist()), f, cut))
        if deep + 1 < depth:
            for part in (rows[x[rows, f] <= cut], rows[x[rows, f] > cut]):
                open_.append((best(part), part, deep + 1))
    return out


def test_trees_grow_best_gain_first(spark):
    rng = np.random.RandomState(7)
    x = rng.randint(0, 6, (500, 3))
    y = np.where(x[:, 0] > 2, x[:, 1] * 3.0, -x[:, 2]) + rng.normal(0, 0.5, 500) + 1e-6 * np.arange(500)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    model = bo.fit_quantiles(df.repartition(3), ["a", "b", "c"], [("y", 0.5)], trees=1, leaves=9, min_leaf=15, depth=4)
    codes = bo._codes(x.astype(float), model.edges)
    (tree,), = model.rounds
    at, got = np.zeros(500, int), []
    for k, (leaf, f, cut) in enumerate(zip(tree.leaf, tree.feature, tree.bins), 1):
        here = at == leaf
        got.append((frozenset(np.flatnonzero(here).tolist()), f, cut))
        at[here & (codes[:, f] > cut)] = k
    want = plain_best_first(codes, y > model.base[0], 0.5, 9, 15, 4)
    assert len(want) >= 5 and [g[0] for g in got] == [w[0] for w in want] and got == want
    assert (tree.assign(codes) == at).all()


def test_predictions_as_expressions_equal_those_in_batches(spark):
    df = boost_rows(spark)
    model = bo.fit_quantiles(df, ["a"], [("y", 0.1), ("y", 0.9)], trees=5, leaves=7)
    odd = spark.createDataFrame([(float("nan"), 0.0), (None, 0.0), (-1e9, 0.0), (1e9, 0.0)], "a double, y double")
    rows = df.unionByName(odd)
    lo, hi = model.columns()
    native = rows.select("a", lo.alias("lo"), hi.alias("hi"))
    plan = native._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    key = lambda r: repr((r["a"], r["lo"], r["hi"]))
    assert sorted(map(key, native.collect())) == sorted(map(key, model.transform(rows, ["lo", "hi"]).collect()))


def test_expressions_make_a_row_once_and_hold_their_trees_as_constants(spark):
    df = boost_rows(spark)
    model = bo.fit_quantiles(df, ["a"], [("y", 0.5)], trees=2, leaves=4)
    plan = df.select(model.columns()[0].alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Project [transform(array(array(" in plan and "from_json" not in plan and "split(" not in plan


def test_leaf_values_are_merged_within_the_rank_error():
    rng = np.random.RandomState(4)
    values = rng.exponential(size=30_001)
    parts = [bo._thinned(v, 500) for v in np.split(values, [12_000, 12_003, 20_000])]
    assert [len(v) for v, _ in parts] == [500, 3, 500, 500]
    for q in (0.1, 0.5, 0.9):
        assert abs((values <= bo._quantile(parts, q)).mean() - q) <= 1 / 500
        assert bo._quantile([bo._thinned(values, 40_000)], q) == np.sort(values)[int(np.ceil(q * 30_001)) - 1]


def test_boosting_adds_up_over_many_tasks_as_over_one(spark):
    df = boost_rows(spark)
    fits = [bo.fit_quantiles(df, ["a"], [("y", 0.1), ("y", 0.5)], trees=5, leaves=6, fan_in=n, cut_every=2) for n in (1, 32)]
    assert [[t.value.tolist() for t in r] for r in fits[0].rounds] == [[t.value.tolist() for t in r] for r in fits[1].rounds]
    codes = bo._codes(np.linspace(-0.5, 1.5, 400)[:, None], fits[0].edges)
    for tree in fits[0].rounds[-1]:
        at = np.zeros(400, int)
        for k, (leaf, feature, cut) in enumerate(zip(tree.leaf, tree.feature, tree.bins), 1):
            at[(at == leaf) & (codes[:, feature] > cut)] = k
        assert (tree.assign(codes) == at).all()


def test_means_count_what_they_sum(spark):
    from hazeline.functions.numeric import exact_avg

    df = spark.createDataFrame([(1.0,), (3.0,), (9.9e18,), (float("nan"),), (None,)], "v double")
    assert df.agg(exact_avg(F.col("v"))).first()[0] == 2.0


def test_a_group_that_does_not_converge_is_an_error(spark):
    rows = [(i % 2, float(i), float(i > 11)) for i in range(24)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    weights = lg.fit_logistic(df, ["g"], ["x"], "y", max_iter=1)
    with pytest.raises(Exception, match="no convergence for [01]"):
        lg.predict_logistic(df, weights, ["g"], ["x"]).collect()


def test_bin_edges_are_the_exact_quantiles_of_what_is_there(spark):
    rng = np.random.RandomState(5)
    x = np.round(rng.exponential(size=3_000), 2)
    rows = [(float(v), float("nan") if i % 3 else None, float(i % 2)) for i, v in enumerate(x)] + [(None, None, None), (float("nan"), None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(5)
    a, b, c = bo._bin_edges(df, ["a", "b", "c"], 8)
    ranked = np.sort(x)
    assert a.tolist() == sorted({ranked[int(np.ceil(k * 3_000 / 8)) - 1] for k in range(1, 8)})
    assert b.tolist() == [] and c.tolist() == [0.0, 1.0]
    thinned = bo._bin_edges(df, ["a"], 8, accuracy=200)[0]
    assert all(abs((x <= e).mean() - k / 8) <= 0.02 for k, e in enumerate(thinned, 1))


def test_rounds_run_without_python_workers(spark, monkeypatch):
    from pyspark import RDD

    def refuse(*_, **__):
        raise AssertionError("a pass over the rows in Python")

    df = boost_rows(spark)
    for name in ("map", "mapPartitions", "mapPartitionsWithIndex"):
        monkeypatch.setattr(RDD, name, refuse)
    model = bo.fit_quantiles(df, ["a"], [("y", 0.1), ("y", 0.5)], trees=2, leaves=4)
    assert [len(r) for r in model.rounds] == [2, 2] and len(model.rounds[0][0].value) == 4


def test_leaves_take_the_exact_quantile_of_their_rows(spark):
    rng = np.random.RandomState(11)
    x = rng.randint(0, 5, 40_000).astype(float)
    y = np.where(rng.rand(40_000) < 0.2, 0.0, np.round(rng.standard_cauchy(40_000), 1)) * (1 + x)
    y[::9] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"a": x, "y": y})).repartition(6)
    cells = [("y", 0.1), ("y", 0.5), ("y", 0.9)]
    exact = bo.fit_quantiles(df, ["a"], cells, trees=3, leaves=4, accuracy=50_000, cut_every=2)
    rough = bo.fit_quantiles(df, ["a"], cells, trees=1, leaves=4, accuracy=500, fan_in=1)
    codes = bo._codes(x[:, None], exact.edges)
    rest = y[:, None] - np.array(exact.base)
    for k, trees in enumerate(exact.rounds):
        for m, tree in enumerate(trees):
            at = tree.assign(codes)
            for leaf, value in enumerate(tree.value):
                here = np.sort(rest[(at == leaf) & ~np.isnan(y), m])
                assert value == here[int(np.ceil(cells[m][1] * len(here) * (1 - 1e-12))) - 1]
                if not k:
                    other = rough.rounds[0][m].value[leaf]
                    assert (here < other).mean() - 0.004 <= cells[m][1] <= (here <= other).mean() + 0.004
            rest[:, m] -= exact.rate * tree.value[at]


def test_expressions_walk_their_trees_in_the_jvm_and_infinities_lie_beyond_every_cut(spark):
    df = boost_rows(spark)
    model = bo.fit_quantiles(df, ["a"], [("y", 0.5)], trees=3, leaves=5)
    inf = float("inf")
    odd = spark.createDataFrame([(inf,), (-inf,), (float("nan"),), (None,), (0.5,)], "a double")
    native = odd.select("a", model.columns()[0].alias("p"))
    assert "UDF(" in native._jdf.queryExecution().optimizedPlan().toString() and "aggregate(" not in native._jdf.queryExecution().optimizedPlan().toString()
    key = lambda r: repr((r["a"], r["p"]))
    assert sorted(map(key, native.collect())) == sorted(map(key, model.transform(odd, ["p"]).collect()))
