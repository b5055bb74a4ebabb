"""Expanding-window ridge regression on log(index) and its predictive distribution.

The training matrix is never rebuilt per as-of date: sums per target date are accumulated
over the calendar, and each (date, horizon) is solved from its accumulated moments.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeline.constants import CATEGORIES, DAILY_FEATURES, INDEX_BANDS, SEVERE_INDEX, VERY_POOR_INDEX
from hazeline.functions.numeric import round_half_even
from hazeline.operators.ordered import percentiles_of, probe_counts, ranked_values
from hazeline.session import broadcast_small, durable

K = len(DAILY_FEATURES)
#: Moments are summed as decimals with 12 digits behind the point: exact in any order and at any size met here.
MOMENT = "decimal(28,12)"
# Fixed shifts that keep the accumulated squares small; they cancel in the solution.
CENTRE = (200.0, 200.0, 200.0, 2.0, 0.0, 0.0)
PAIRS = [(i, j) for i in range(K) for j in range(i, K)]
SUMS = ["n", "sy", *[f"sx{i}" for i in range(K)], *[f"sxy{i}" for i in range(K)], *[f"sxx{i}_{j}" for i, j in PAIRS]]

LABELS = {
    "aqi_d": "AQI today", "aqi_d_minus_1": "AQI yesterday", "mean_aqi_7d": "seven-day mean AQI",
    "pm_ratio": "coarse to fine particle ratio", "month_sin": "season (sine)", "month_cos": "season (cosine)",
}


def winter_start(date: Column) -> Column:
    """First calendar year of the winter a day belongs to; null outside October-February."""
    m = F.month(date)
    return F.when(m >= 10, F.year(date)).when(m <= 2, F.year(date) - 1)


def expanding_train(features: DataFrame, daily: DataFrame, horizons=(1, 2, 3), by: list[str] = ("season",)) -> DataFrame:
    """Training rows: features of day t with y = log(index) of day t + h, where that day is positive."""
    target = daily.where(F.col("aqi") > 0).select("station", F.col("date").alias("target_date"), F.log("aqi").alias("y"), *by)
    rows = features.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn(
        "target_date", F.date_add("date", F.col("horizon")))
    return rows.join(target, ["station", "target_date", *by], "inner")


def expanding_moments(train: DataFrame, as_of: DataFrame, by: list[str] = ("season",)) -> DataFrame:
    """Accumulated moments of all rows with target date <= as-of date, per horizon.

    `as_of` has (by..., horizon, date). The windows run over calendar days, not rows.
    """
    x = [F.col(n) - c for n, c in zip(DAILY_FEATURES, CENTRE)]
    y = F.col("y")
    parts = {"sy": y} | {f"sx{i}": x[i] for i in range(K)} | {f"sxy{i}": x[i] * y for i in range(K)}
    parts |= {f"sxx{i}_{j}": x[i] * x[j] for i, j in PAIRS}
    sums = {"n": F.count(F.lit(1))} | {n: F.sum(c.cast(MOMENT)) for n, c in parts.items()}
    per_day = train.groupBy(*by, "horizon", F.col("target_date").alias("date")).agg(*[c.alias(n) for n, c in sums.items()])
    asked = as_of.select(*by, "horizon", "date").distinct().withColumn("_ask", F.lit(1))
    both = per_day.unionByName(asked, allowMissingColumns=True)
    w = Window.partitionBy(*by, "horizon").orderBy("date").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    run = both.withColumns({n: F.coalesce(F.sum(n).over(w), F.lit(0)) for n in SUMS})
    return run.where("_ask = 1").select(
        *by, "horizon", "date", F.col("n").alias("n_train"), *[F.col(n).cast("double").alias(n) for n in SUMS[1:]])


def _solve_one(row, alpha: float) -> tuple:
    n = float(row["n_train"])
    mean = np.array([row[f"sx{i}"] for i in range(K)]) / n
    y_bar = row["sy"] / n
    cov = np.empty((K, K))
    for i, j in PAIRS:
        cov[i, j] = cov[j, i] = row[f"sxx{i}_{j}"] - n * mean[i] * mean[j]
    sigma = np.sqrt(np.maximum(np.diag(cov), 0.0) / (n - 1.0))
    sigma[sigma < 1e-9] = 1.0
    zz = cov / np.outer(sigma, sigma)
    zy = (np.array([row[f"sxy{i}"] for i in range(K)]) - n * mean * y_bar) / sigma
    beta = np.linalg.solve(zz + alpha * np.eye(K), zy)
    return y_bar, beta.tolist(), (mean + np.array(CENTRE)).tolist(), sigma.tolist()


def ridge_expanding(moments: DataFrame, alpha: float = 1.0, min_rows: int = 30, by: list[str] = ("season",)) -> DataFrame:
    """Intercept, coefficients, means and deviations per (date, horizon); too few rows are skipped."""
    keys = [*by, "horizon", "date"]
    ready = moments.where(F.col("n_train") >= min_rows)
    types = dict(ready.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in (*keys, "n_train")) + (
        ", intercept double, beta array<double>, mu array<double>, sigma array<double>")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[[*keys, "n_train"]].copy()
            solved = [_solve_one(r, alpha) for r in pdf.to_dict("records")]
            for i, name in enumerate(("intercept", "beta", "mu", "sigma")):
                out[name] = [s[i] for s in solved]
            yield out

    return ready.mapInPandas(solve, schema)


def _zip_dot(names, beta: Column, mu: Column, sigma: Column) -> list[Column]:
    return [beta[i] * ((F.col(n) - mu[i]) / sigma[i]) for i, n in enumerate(names)]


def predict_points(features: DataFrame, coefficients: DataFrame, by: list[str] = ("season",)) -> DataFrame:
    """Point forecasts on the log scale with the contribution of every feature."""
    rows = features.join(coefficients, [*by, "date"], "inner")
    parts = _zip_dot(DAILY_FEATURES, F.col("beta"), F.col("mu"), F.col("sigma"))
    out = rows.withColumn("contributions", F.array(*parts))
    total = sum((F.col("contributions")[i] for i in range(K)), F.lit(0.0))
    return out.withColumn("point", F.col("intercept") + total).withColumn(
        "target_date", F.date_add("date", F.col("horizon")))


#: Training rows a task holds at a time, residuals of a fit in one slice of their values, and slices of a fit at most.
CHUNK, SLICE, SLICES = 1 << 15, 1 << 17, 256


def residual_bounds(train: DataFrame, coefficients: DataFrame, by: list[str] = ("season",)) -> DataFrame:
    """(by..., horizon, _last, _chunks, bounds): the last as-of date, in how many chunks its training rows are dealt, and the
    values that cut residuals into slices of about `SLICE`.

    The bounds are approximate quantiles of the last fit's residuals. They only deal the work: ranks do not depend on them.
    """
    group = [*by, "horizon"]
    last = coefficients.groupBy(*group).agg(
        F.max("date").alias("_last"), F.max_by(F.struct("n_train", "intercept", "beta", "mu", "sigma"), "date").alias("_f"))
    rows = train.join(F.broadcast(last), group, "inner").where("target_date <= _last")
    parts = _zip_dot(DAILY_FEATURES, F.col("_f.beta"), F.col("_f.mu"), F.col("_f.sigma"))
    residual = F.col("y") - (F.col("_f.intercept") + sum(parts, F.lit(0.0)))
    steps = [k / SLICES for k in range(1, SLICES)]
    found = rows.groupBy(*group).agg(
        F.max("_last").alias("_last"), F.max("_f.n_train").alias("_n"), F.percentile_approx(residual, steps).alias("_q"))
    wanted = F.least(F.lit(SLICES), F.ceil(F.col("_n") / SLICE)).cast("int")
    picked = F.when(wanted > 1, F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), wanted - 1)), lambda k: F.get("_q", F.floor(k * SLICES / wanted).cast("int") - 1)))
    return found.select(
        *group, "_last", F.ceil(F.col("_n") / CHUNK).cast("int").alias("_chunks"),
        F.coalesce(F.array_distinct(picked), F.array().cast("array<double>")).alias("bounds"))


def training_residuals(train: DataFrame, coefficients: DataFrame, bounds: DataFrame, by: list[str] = ("season",)) -> DataFrame:
    """Residuals of every training row under the fit of every later as-of date, as sorted runs.

    A task holds a chunk of a season's training rows and the fits of that season (as many as it has days). A run has
    the residuals of its chunk in one slice of one fit: `n` of them, the distinct ones as 8-byte numbers in `residuals`,
    with how often each occurs in `times` unless that is once.
    """
    group = [*by, "horizon"]
    dealt = F.broadcast(bounds)
    rows = train.join(dealt, group, "inner").where("target_date <= _last").select(
        *group, F.pmod(F.xxhash64("station", "target_date"), "_chunks").cast("int").alias("_chunk"),
        F.unix_date("target_date").alias("_day"), "y", *DAILY_FEATURES)
    fits = coefficients.join(dealt, group, "inner").select(
        *group, F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_chunk"),
        F.unix_date("date").alias("_day"), "intercept", "beta", "mu", "sigma", "bounds")
    types = dict(coefficients.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in group) + ", _day int, slice int, n long, residuals binary, times binary"

    def run(key: tuple, mine: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values("_day", kind="stable")
        day, y = mine["_day"].to_numpy(), mine["y"].to_numpy()
        x = [mine[name].to_numpy(np.float64) for name in DAILY_FEATURES]
        out = []
        for fit in models.to_dict("records"):
            n = int(np.searchsorted(day, fit["_day"], side="right"))
            total = np.zeros(n)
            for i in range(K):
                total += fit["beta"][i] * ((x[i][:n] - fit["mu"][i]) / fit["sigma"][i])
            values, times = np.unique(y[:n] - (fit["intercept"] + total), return_counts=True)
            cuts = [0, *np.searchsorted(values, np.asarray(fit["bounds"], np.float64), side="left"), len(values)]
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                if b > a:
                    often = times[a:b]
                    out.append((fit["_day"], k, int(often.sum()), values[a:b].tobytes(), None if often.max() == 1 else often.astype(np.int64).tobytes()))
        found = pd.DataFrame(out, columns=["_day", "slice", "n", "residuals", "times"])
        for i, name in enumerate(group):
            found.insert(i, name, key[i])
        return found

    chunks = [*group, "_chunk"]
    runs = rows.groupBy(*chunks).cogroup(fits.groupBy(*chunks)).applyInPandas(run, schema)
    return runs.withColumn("date", F.date_from_unix_date("_day")).drop("_day")


def _edges() -> list[tuple[str, float, bool]]:
    """(name, index, whether a value at the index lies below) of the category edges."""
    edges = [(f"lo{k}", float(lo), False) for k, (lo, _) in enumerate(INDEX_BANDS) if k]
    return edges + [(f"hi{k}", float(hi), True) for k, (_, hi) in enumerate(INDEX_BANDS)]


def distribution_of_runs(points: DataFrame, runs: DataFrame, bounds: DataFrame, by: list[str] = ("season",)) -> DataFrame:
    """`predictive_distribution` of exp(point + residual) for the runs of `training_residuals`, which have to be written.

    A slice of a fit is merged by one task, for the points that have a category edge in it (a point asks at most as
    many slices as there are edges); what lies in lower slices is added from the counts per slice.
    """
    edges, probs = _edges(), (0.1, 0.9)
    keys = [*by, "horizon", "date"]
    ids, group = [*keys, "station"], [*keys, "slice"]
    counted = runs.groupBy(*group).agg(F.sum("n").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("slice")
    held = counted.select(
        *group, (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_size"))
    sizes = held.groupBy(*keys).agg(F.max("_size").alias("_size"), F.sort_array(F.collect_list(F.struct("slice", "_before"))).alias("_held"))
    sizes = broadcast_small(durable(sizes.join(F.broadcast(bounds.select(*by, "horizon", "bounds")), [*by, "horizon"], "inner")))
    xs = F.array(*[F.log(F.lit(v)) - F.col("point") for _, v, _ in edges])
    slices = F.transform("_xs", lambda x: F.size(F.filter("bounds", lambda b: b <= x)))
    asked = points.select(*ids, "point").join(sizes, keys, "inner").withColumn("_xs", xs).withColumn("_at", slices)
    asked = asked.withColumn("slice", F.explode(F.array_distinct("_at")))
    # all residuals of lower slices lie below; with no run in the slice itself, those of the slices up to it
    lower = F.filter("_held", lambda h: h["slice"] >= F.col("slice"))
    before = F.when(F.size(lower) > 0, F.get(lower, 0)["_before"]).otherwise(F.col("_size"))
    asked = asked.select(*group, "station", "_xs", "_at", before.alias("_before"), "_size").unionByName(
        held.withColumn("station", F.lit(None).cast("string")), allowMissingColumns=True)
    types = dict(points.dtypes)
    ends = [f"{e}{round(100 * p)}" for p in probs for e in ("lo", "hi")]
    schema = ", ".join(f"`{k}` {types[k]}" for k in ids) + ", below array<long>, " + ", ".join(f"{e} double" for e in ends)

    def merge(key: tuple, mine: pa.Table, wanted: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b, np.float64) for b in mine["residuals"].to_pylist()]
        times = [np.ones(len(v), np.int64) if b is None else np.frombuffer(b, np.int64) for v, b in zip(parts, mine["times"].to_pylist())]
        values = np.concatenate([np.zeros(0), *parts])
        order = np.argsort(values, kind="stable")
        values, upto = values[order], np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *times])[order])])
        rows = wanted.filter(wanted["station"].is_valid())
        before = rows["_before"].to_numpy()[:, None]
        x, at = (rows[c].combine_chunks().flatten().to_numpy().reshape(-1, len(edges)) for c in ("_xs", "_at"))
        inside = np.stack([upto[np.searchsorted(values, x[:, i], side="right" if inc else "left")] for i, (_, _, inc) in enumerate(edges)], axis=1)
        below = np.where(at == key[-1].as_py(), inside + before, 0).ravel()
        out = {"station": rows["station"].to_pylist(), "below": np.split(below, len(x)) if len(x) else []} | {e: [None] * len(x) for e in ends}
        for one in wanted.filter(wanted["station"].is_null()).to_pylist():
            out["station"].append(None)
            out["below"].append(None)
            for p in probs:
                place = p * (one["_size"] - 1)
                for e, rank in (("lo", math.floor(place)), ("hi", math.ceil(place))):
                    rank -= one["_before"]
                    here = 0 <= rank < upto[-1]
                    out[f"{e}{round(100 * p)}"].append(float(values[np.searchsorted(upto, rank, side="right") - 1]) if here else None)
        kinds = {"station": pa.string(), "below": pa.list_(pa.int64())}
        n = len(out["station"])
        return pa.table({k: pa.array([v.as_py()] * n, v.type) for k, v in zip(keys, key)} | {
            c: pa.array(v, kinds.get(c, pa.float64())) for c, v in out.items()})

    ranked = durable(runs.groupBy(*group).cogroup(asked.groupBy(*group)).applyInArrow(merge, schema))
    size = F.col("_size")

    def end(p: float):
        lo, hi, at = f"lo{round(100 * p)}", f"hi{round(100 * p)}", F.lit(p) * (size - 1)
        return F.struct(F.col(lo).alias("lo"), F.col(hi).alias("hi"), (at - F.floor(at)).alias("frac")).alias(f"e{round(100 * p)}")

    found = ranked.where("station IS NULL").groupBy(*keys).agg(*[F.max(e).alias(e) for e in ends])
    cut = found.join(sizes.select(*keys, "_size"), keys, "inner").select(*keys, *[end(p) for p in probs], size.alias("n_residuals"))
    counts = ranked.where("station IS NOT NULL").groupBy(*ids).agg(
        *[F.sum(F.get("below", F.lit(i))).alias(n) for i, (n, _, _) in enumerate(edges)])
    return _shares(points.join(broadcast_small(durable(cut)), keys, "inner").join(counts, ids, "inner"))


def predictive_distribution(points: DataFrame, residuals: DataFrame, keys: list[str]) -> DataFrame:
    """80 % interval, category probabilities and event probabilities of exp(point + residual).

    `keys` identify the residual set of a point, e.g. (season, horizon, date). Probabilities
    are counts of residuals below the category edges minus the point, found in one sorted
    pass; samples are never materialised.
    """
    ids = [*keys, "station"]
    edges = _edges()
    probe = F.explode(F.array(*[
        F.struct(F.lit(n).alias("edge"), F.log(F.lit(v)).alias("log_edge"), F.lit(inc).alias("inclusive")) for n, v, inc in edges
    ]))
    asked = points.select(*ids, "point", probe.alias("e")).select(
        *ids, "e.edge", "e.inclusive", (F.col("e.log_edge") - F.col("point")).alias("x"))
    ranked = ranked_values(residuals, keys, "residual", probes=asked, probe="x", inclusive="inclusive")
    ends = percentiles_of(ranked, keys, {"e10": 0.1, "e90": 0.9}, ends=True)
    ranks = probe_counts(ranked, keys, "x")
    counts = ranks.groupBy(*ids).agg(
        F.max("n_values").alias("n_residuals"),
        *[F.max(F.when(F.col("edge") == n, F.col("n_below"))).alias(n) for n, _, _ in edges],
    ).where("n_residuals > 0")
    return _shares(points.join(ends, keys, "inner").join(counts, ids, "inner"))


def _shares(joined: DataFrame) -> DataFrame:
    """Interval and probabilities from a point's `n_residuals`, its counts below the edges and the ends `e10` and `e90`."""
    size = F.col("n_residuals")
    inside = {}
    for k, name in enumerate(CATEGORIES):
        inside[name] = F.col(f"hi{k}") - (F.col(f"lo{k}") if k else F.lit(0))
    severe = inside["Severe"] + (size - F.col("hi5"))
    good = size - severe - sum((inside[c] for c in CATEGORIES[1:5]), F.lit(0))  # gaps count as Good
    share = {**inside, "Severe": severe, "Good": good}

    def quantile(e: str) -> Column:
        lo, hi = F.exp(F.col("point") + F.col(f"{e}.lo")), F.exp(F.col("point") + F.col(f"{e}.hi"))
        return lo + F.col(f"{e}.frac") * (hi - lo)

    probability = F.create_map(*[
        x for c in CATEGORIES for x in (F.lit(c), round_half_even(share[c] / size, 4))
    ])
    out = joined.withColumns({
        "point_aqi": round_half_even(F.exp("point"), 1),
        "q10": round_half_even(quantile("e10"), 1), "q90": round_half_even(quantile("e90"), 1),
        "category_probabilities": probability,
        "p_severe": round_half_even((size - F.col("lo5")) / size, 4),
        "p_very_poor": round_half_even((size - F.col("lo4")) / size, 4),
    })
    return out.drop("e10", "e90", "n_values", *[n for n, _, _ in _edges()])


assert SEVERE_INDEX == INDEX_BANDS[5][0] and VERY_POOR_INDEX == INDEX_BANDS[4][0]


def top_contributions(points: DataFrame, n: int = 3) -> DataFrame:
    """The n largest contributions by magnitude, earlier feature first on ties."""
    items = F.array(*[
        F.struct(
            (-F.abs(F.col("contributions")[i])).alias("order"), F.lit(i).alias("i"), F.lit(name).alias("feature"),
            F.lit(LABELS[name]).alias("label"), F.col("contributions")[i].alias("contribution"), F.col(name).alias("feature_value"),
        ) for i, name in enumerate(DAILY_FEATURES)
    ])
    top = F.transform(F.slice(F.sort_array(items), 1, n), lambda s: F.struct(
        s["feature"].alias("feature"), s["label"].alias("label"),
        s["contribution"].alias("contribution"), s["feature_value"].alias("feature_value")))
    return points.withColumn("top_reasons", top)


def daily_forecasts(features: DataFrame, daily: DataFrame, alpha: float = 1.0, min_rows: int = 30, horizons=(1, 2, 3)) -> DataFrame:
    """Probabilistic forecasts of every station and as-of date, winter by winter.

    `features` and `daily` carry a `season` column; each season expands on its own.
    """
    features = durable(features)
    train = durable(expanding_train(features, daily, horizons))
    as_of = daily.select("season", "date").distinct().withColumn(
        "horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    coefficients = durable(ridge_expanding(expanding_moments(train, as_of), alpha, min_rows))
    points = predict_points(features, coefficients)
    bounds = durable(residual_bounds(train, coefficients))
    runs = durable(training_residuals(train, coefficients, bounds))
    return top_contributions(distribution_of_runs(points, runs, bounds))
