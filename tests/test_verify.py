import random

import numpy as np
from pyspark.sql import functions as F

from hazeline.operators import verify as vf


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def resample(y, p, r, draw, reps, block=7):
    n = len(y)
    blocks = [list(range(i, min(i + block, n))) for i in range(0, n, block)]
    out = []
    for rep in range(reps):
        idx = [i for pos in range(len(blocks)) for i in blocks[draw(rep, pos, len(blocks))]][:n]
        out.append((np.mean((p[idx] - y[idx]) ** 2), np.mean((r[idx] - y[idx]) ** 2)))
    return out


def test_brier_and_skill(spark):
    df = spark.createDataFrame([(1, 0.8), (0, 0.2), (1, 0.6), (0, 0.1)], "y int, p double")
    assert abs(vf.brier_score(df, "y", "p", []).first()["brier"] - 0.0625) < 1e-12
    assert one(spark, vf.brier_skill(F.lit(0.1), F.lit(0.1))) == 0.0
    assert one(spark, vf.brier_skill(F.lit(0.0), F.lit(0.0))) == 0.0
    assert one(spark, vf.brier_skill(F.lit(0.2), F.lit(0.0))) == float("-inf")


def test_bootstrap_equals_plain_resampling(spark):
    rng = np.random.RandomState(0)
    for n in (42, 45, 8, 7):
        y, p, r = (rng.rand(n) > 0.5).astype(float), rng.rand(n), rng.rand(n)
        df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(y, p, r))], "o int, y double, p double, r double")
        nb = -(-n // 7)
        seq = np.random.RandomState(42).randint(0, nb, size=60 * nb)
        draws = spark.createDataFrame([(i // nb, i % nb, int(d)) for i, d in enumerate(seq)], "rep long, pos long, drawn long")
        want = resample(y, p, r, lambda rep, pos, k: seq[rep * k + pos], 60)
        got = vf.block_bootstrap(df, [], ["o"], "y", "p", "r", reps=60, draws=draws).orderBy("rep").collect()
        assert np.allclose([g["brier"] for g in got], [w[0] for w in want], atol=1e-8)
        assert np.allclose([g["brier_ref"] for g in got], [w[1] for w in want], atol=1e-8)


def test_bootstrap_groups_with_counter_draws(spark):
    rows = [(g, i, float(i % 3 == 0), (i * 37 % 100) / 100) for g, n in (("a", 50), ("b", 33)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, o int, y double, p double")
    got = vf.bootstrap_interval(vf.block_bootstrap(df, ["g"], ["o"], "y", "p", reps=100), ["g"], ["brier"]).collect()
    for r in got:
        mean = np.mean([(p - y) ** 2 for g, _, y, p in rows if g == r["g"]])
        assert r["brier_lo"] < mean < r["brier_hi"]


def test_bootstrap_draws_are_made_where_the_blocks_are(spark, monkeypatch):
    rows = [(g, i, float(i % 3 == 0), (i * 37 % 100) / 100, (i * 11 % 100) / 100) for g, n in (("a", 50), ("b", 35), ("c", 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, o int, y double, p double, r double")
    for chunk, share in ((vf.CHUNK, vf.SHARE), (2, 40)):  # one task per group; several chunks of blocks and shares of repetitions
        monkeypatch.setattr(vf, "CHUNK", chunk)
        monkeypatch.setattr(vf, "SHARE", share)
        out = vf.block_bootstrap(df, ["g"], ["o"], "y", "p", "r", reps=40)
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[1]
        got = {(r["g"], r["rep"]): (r["brier"], r["brier_ref"]) for r in out.collect()}
        for g, n in (("a", 50), ("b", 35), ("c", 3)):
            y, p, q = (np.array([r[k] for r in rows if r[0] == g]) for k in (2, 3, 4))
            draw = lambda rep, pos, k: int(vf.counter_draws(np.array([rep]), np.array([pos]), k)[0])
            want = resample(y, p, q, draw, 40)
            assert np.allclose([got[g, i] for i in range(40)], want, atol=1e-8)


def test_counter_draws_agree(spark):
    rep, pos = np.arange(3000) % 1000, np.arange(3000) * 977
    d = spark.createDataFrame(list(zip(rep.tolist(), pos.tolist())), "rep long, pos long")
    got = [r["b"] for r in d.select(vf.counter_draw(F.col("rep"), F.col("pos"), F.lit(613)).alias("b")).collect()]
    assert got == vf.counter_draws(rep, pos, 613).tolist()


def test_counter_draws_are_even(spark):
    d = spark.range(20000).select(vf.counter_draw(F.col("id") % 1000, F.floor(F.col("id") / 1000).cast("long"), F.lit(10)).alias("b"))
    counts = [r["count"] for r in d.groupBy("b").count().collect()]
    assert len(counts) == 10 and min(counts) > 1700 and max(counts) < 2300


def test_reliability_edges(spark):
    df = spark.createDataFrame([(0.6, 1.0), (0.6000000000000001, 0.0), (1.0, 1.0), (0.0, 0.0)], "p double, y double")
    assert sorted((r["bin"], r["n"]) for r in vf.reliability_5(df, "y", "p", []).collect()) == [(0, 1), (2, 1), (3, 1), (4, 1)]


def test_metrics_without_pairs(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", 1.0, 3.0)], "g string, y double, f double")
    got = {r["g"]: (r["mae"], r["bias"], r["n"]) for r in vf.continuous_metrics(df, "y", "f", ["g"]).collect()}
    assert got == {"a": (None, None, 0), "b": (2.0, 2.0, 1)}
