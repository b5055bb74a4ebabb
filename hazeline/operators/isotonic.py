"""Isotonic calibration by pools of adjacent violators that merge.

Pooling a run of points and then the pools gives the same fit as pooling all points, so every task
pools its range of probabilities and only pools go on. They are pooled a second time in order, as a
stream that holds the pools alone: for yes/no outcomes on N rows their rates are different fractions
with denominators that add up to N at most, so there are about N**(2/3) of them. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.operators.ordered import place
from hazeline.session import broadcast_small, durable

_POOL = "lo double, hi double, total double, weight double"


def pool(pools: list[list[float]], lo: float, hi: float, total: float, weight: float) -> None:
    """Appends a run of points to the pools (lo, hi, total, weight) and merges while the mean does not rise."""
    pools.append([lo, hi, total, weight])
    while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
        _, hi, total, weight = pools.pop()
        last = pools[-1]
        last[1], last[2], last[3] = hi, last[2] + total, last[3] + weight


def _pooled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pools: list[list[float]] = []
    for pdf in batches:
        for row in zip(*(pdf[c].tolist() for c in ("lo", "hi", "total", "weight"))):
            pool(pools, *row)
    yield pd.DataFrame(pools, columns=["lo", "hi", "total", "weight"])


def fit(train: DataFrame, p: str, y: str) -> DataFrame:
    """(lo, hi, mean, weight) of the non-decreasing fit of `y` on `p`, a row per pool; rows with a null or NaN in either take no part."""
    known = train.select(F.col(p).cast("double").alias("lo"), F.col(y).cast("double").alias("_y")).where(
        "lo IS NOT NULL AND NOT isnan(lo) AND _y IS NOT NULL AND NOT isnan(_y)")
    points = known.groupBy("lo").agg(F.col("lo").alias("hi"), F.sum("_y").alias("total"), F.count(F.lit(1)).cast("double").alias("weight"))
    parts = durable(points.repartitionByRange("lo").sortWithinPartitions("lo").mapInPandas(_pooled, _POOL))
    whole = parts.repartition(1).sortWithinPartitions("lo").mapInPandas(_pooled, _POOL)
    return durable(whole.select("lo", "hi", (F.col("total") / F.col("weight")).alias("mean"), "weight"))


def predict(pools: DataFrame, rows: DataFrame, p: str, out: str) -> DataFrame:
    """`rows` with the fitted value: a pool's mean within it, a straight line between pools, the end values outside.

    Null where `p` is null or NaN, or nothing was fitted. Distinct probabilities are placed among the
    pools by range; the rows meet them by equality.
    """
    probes = rows.select(F.col(p).cast("double").alias("_x")).where("_x IS NOT NULL AND NOT isnan(_x)").distinct().withColumn("_pool", F.lit(0))
    both = probes.unionByName(pools.select(F.col("lo").alias("_x"), F.lit(1).alias("_pool"), "hi", "mean"), allowMissingColumns=True)
    numbered = durable(place(both, [], ["_x", "_pool"]).running({"_k": F.col("_pool").cast("long")}).rows())
    # a probe comes before the pool that begins at the same place, where the line has reached its mean
    held = numbered.where("_pool = 1").select("_k", F.col("_x").alias("lo"), "hi", "mean")
    below = broadcast_small(held.select("_k", F.col("hi").alias("_from"), F.col("mean").alias("_low")))
    above = broadcast_small(held.select((F.col("_k") - 1).alias("_k"), F.col("lo").alias("_to"), F.col("mean").alias("_high")))
    x = F.col("_x")
    share = (x - F.col("_from")) / (F.col("_to") - F.col("_from"))
    value = F.when(F.col("_low").isNull(), F.col("_high")).when((x <= F.col("_from")) | F.col("_high").isNull(), F.col("_low")).otherwise(
        F.col("_low") + share * (F.col("_high") - F.col("_low")))
    fitted = numbered.where("_pool = 0").select("_k", "_x").join(below, "_k", "left").join(above, "_k", "left").select("_x", value.alias("_fit"))
    met = rows.withColumn("_p", F.col(p).cast("double")).join(broadcast_small(durable(fitted)), F.col("_p") == x, "left")
    return met.withColumn(out, F.when(F.col("_fit").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_fit"))))).drop("_p", "_x", "_fit")


def isotonic_calibrate(train: DataFrame, test: DataFrame, p: str, y: str, out: str) -> DataFrame:
    """Non-decreasing calibration of the probabilities of `test`, fitted on `train`, clipped to [0, 1] and to the trained range."""
    return predict(fit(train, p, y), test, p, out)
