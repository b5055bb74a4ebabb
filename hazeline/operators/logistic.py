"""Penalised logistic regression for many groups at once.

Every Newton step is one grouped aggregation (gradient and Hessian sums) and one small
solve per group, so a station, an event and a horizon more are a group more, not a job more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.session import cut, durable


def _linear(names: list[str], shift: list[str]) -> Column:
    total = F.col("_w")[0]
    for i, (n, s) in enumerate(zip(names, shift)):
        total = total + F.col("_w")[i + 1] * (F.col(n) - F.col(s))
    return total


def _sigmoid(eta: Column) -> Column:
    capped = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), eta))
    return 1.0 / (1.0 + F.exp(-capped))


def fit_logistic(
    train: DataFrame, by: list[str], features: list[str], label: str, c: float = 1.0, max_iter: int = 100, tol: float = 1e-9,
) -> DataFrame:
    """Weights per group: `_w` (intercept first), feature means `_m<i>`, `constant` for one-class groups.

    Minimises C * log-loss + |w|^2 / 2 with a free intercept. Features are shifted by their
    group mean, which changes only the intercept. Newton steps go on until none is above `tol`;
    `converged` is false for groups that `max_iter` steps did not bring there.
    """
    d = len(features) + 1
    means = [f"_m{i}" for i in range(len(features))]
    train = durable(train.select(*by, *features, label))  # every step reads it
    start = train.groupBy(*by).agg(
        *[F.avg(f).alias(m) for f, m in zip(features, means)], F.avg(label).alias("_rate"))
    one_class = (F.col("_rate") == 0) | (F.col("_rate") == 1)
    state = start.withColumns({
        "constant": F.when(one_class, F.col("_rate")),
        "_w": F.array(F.when(one_class, 0.0).otherwise(F.log(F.col("_rate") / (1 - F.col("_rate")))), *[F.lit(0.0)] * (d - 1)),
        "_step": F.lit(float("inf")),
    }).drop("_rate")
    state = cut(state)
    types = dict(state.dtypes)
    names = list(state.columns)
    schema = ", ".join(f"{n} {types[n]}" for n in names)
    tri = [(i, j) for i in range(d) for j in range(i, d)]

    def update(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            weights, steps = [], []
            for r in pdf.to_dict("records"):
                w = np.array(r["_w"], dtype=float)
                if r["constant"] is not None and not np.isnan(r["constant"]):
                    weights.append(w.tolist())
                    steps.append(0.0)
                    continue
                pen = np.ones(d)
                pen[0] = 0.0
                grad = c * np.array([r[f"g{i}"] for i in range(d)]) + pen * w
                hess = np.diag(pen)
                for i, j in tri:
                    hess[i, j] += c * r[f"h{i}_{j}"]
                    if i != j:
                        hess[j, i] += c * r[f"h{i}_{j}"]
                hess[np.diag_indices(d)] += 1e-10
                step = np.linalg.solve(hess, grad)
                size = float(np.max(np.abs(step)))
                if size > 5.0:
                    step *= 5.0 / size
                weights.append((w - step).tolist())
                steps.append(size)
            out = pdf[names].copy()
            out["_w"], out["_step"] = weights, steps
            yield out

    for _ in range(max_iter):
        rows = train.join(state, by, "inner").where("constant IS NULL")
        p = _sigmoid(_linear(features, means))
        x = [F.lit(1.0)] + [F.col(f) - F.col(m) for f, m in zip(features, means)]
        rows = rows.withColumns({"_e": p - F.col(label), "_v": p * (1 - p)})
        sums = rows.groupBy(*by).agg(
            *[F.sum(F.col("_e") * x[i]).alias(f"g{i}") for i in range(d)],
            *[F.sum(F.col("_v") * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in tri])
        state = cut(state.join(sums, by, "left").mapInPandas(update, schema))
        if state.agg(F.max("_step")).first()[0] < tol:
            break
    return state.withColumn("converged", F.col("constant").isNotNull() | (F.col("_step") < tol)).drop("_step")


def predict_logistic(test: DataFrame, weights: DataFrame, by: list[str], features: list[str], out: str = "p_model") -> DataFrame:
    """Event probability per row; one-class groups give their class. A group that did not converge is an error."""
    means = [f"_m{i}" for i in range(len(features))]
    p = F.coalesce(F.col("constant"), _sigmoid(_linear(features, means)))
    group = F.concat_ws(", ", *[F.col(b).cast("string") for b in by])
    p = F.when(F.col("converged"), p).otherwise(F.raise_error(F.concat(F.lit("no convergence for "), group)).cast("double"))
    return test.join(weights, by, "inner").withColumn(out, p).drop("_w", "constant", "converged", *means)
