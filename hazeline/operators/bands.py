"""72-hour quantile bands, index quantiles and the severe-risk indicator."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeline.constants import (
    BAND_FLOOR, BLEND_WEIGHTS, FALLBACK_BAND, INTERVAL_TO_SD, LEAD_WIDENING, MIN_SD, POLLUTANTS,
)
from hazeline.functions.clock import plus_hours
from hazeline.functions.index import SEVERE_ABOVE, aqi_category, pm_index, pm_index_text, pm_to_aqi
from hazeline.operators.daily import aqi_quantile_order
from hazeline.operators.features import targets_at_valid_time

Q = ("p10", "p50", "p90")


def monotone_quantiles(df: DataFrame, names: dict[str, tuple[str, str, str]]) -> DataFrame:
    """p10 = max(0, q10), p50 = max(p10, q50), p90 = max(p50, q90) per named triple."""
    out = {}
    for name, (a, b, c) in names.items():
        p10 = F.greatest(F.lit(0.0), F.col(a))
        p50 = F.greatest(p10, F.col(b))
        out |= {f"{name}_p10": p10, f"{name}_p50": p50, f"{name}_p90": F.greatest(p50, F.col(c))}
    return df.withColumns(out)


WIDEN = f"(1.0D + {LEAD_WIDENING!r}D * lead_h)"


def blend_band(p: str) -> tuple[str, str, str]:
    """SQL text of one pollutant's band from the residual struct `res_<p>`."""
    driver, r, floor = f"driver_{p}", f"res_{p}", f"{BAND_FLOOR[p]!r}D"
    corrected = f"greatest(0.0D, {driver} + {r}.mean)"
    if p in ("pm25", "pm10"):
        mid = corrected
        low = f"greatest({floor}, {r}.mean - {r}.p10) * {WIDEN}"
        high = f"greatest({floor}, {r}.p90 - {r}.mean) * {WIDEN}"
    else:
        near, mean, far = BLEND_WEIGHTS[p]
        w = f"(CASE WHEN lead_h <= 24 THEN {near!r}D WHEN lead_h <= 48 THEN {mean!r}D ELSE {far!r}D END)"
        last = f"last_obs_{p}"
        mid = f"(CASE WHEN {last} IS NULL THEN {corrected} ELSE {w} * {last} + (1.0D - {w}) * {corrected} END)"
        low = high = f"greatest({floor}, ({r}.p90 - {r}.p10) / 2.0D) * {WIDEN}"
    return f"greatest(0.0D, {mid} - {low})", mid, f"{mid} + {high}"


def fallback_band(p: str) -> tuple[str, str, str]:
    """SQL text of the wide band around the raw driver."""
    least, share = FALLBACK_BAND[p]
    half = f"greatest({least!r}D, {share!r}D * driver_{p}) * {WIDEN}"
    return f"greatest(0.0D, driver_{p} - {half})", f"driver_{p}", f"driver_{p} + {half}"


def _where_driver(p: str, text: str) -> Column:
    return F.expr(f"CASE WHEN driver_{p} IS NOT NULL THEN {text} END")


def residual_structs(residuals: DataFrame) -> DataFrame:
    """One row per (station, issue_time) with a struct of statistics per pollutant."""
    def stats(p: str) -> Column:
        here = F.col("pollutant") == p
        return F.struct(*[
            F.max(F.when(here, F.col(f"res_{s}"))).alias(s) for s in ("mean", "p10", "p90")
        ]).alias(f"res_{p}")

    return residuals.groupBy("station", "issue_time").agg(*[stats(p) for p in POLLUTANTS])


def quantile_bands(samples: DataFrame, guard: DataFrame, residuals: DataFrame) -> DataFrame:
    """Samples with p10/p50/p90 of every pollutant, by guard status; rounded to one decimal."""
    rows = samples.join(guard, ["station", "issue_time"], "left").join(
        residual_structs(residuals), ["station", "issue_time"], "left")
    out = {}
    for p in POLLUTANTS:
        for q, good, wide in zip(Q, blend_band(p), fallback_band(p)):
            value = f"CASE WHEN bias_correction = 'applied' THEN {good} ELSE {wide} END"
            out[f"{p}_{q}"] = _where_driver(p, f"rint(({value}) * 10.0D) / 10.0D")
    return rows.withColumns(out)


def blend_bands(samples: DataFrame, residuals: DataFrame) -> DataFrame:
    """Unrounded bands with the guard passed everywhere."""
    return blend_columns(samples.join(residual_structs(residuals), ["station", "issue_time"], "left"))


def blend_columns(rows: DataFrame) -> DataFrame:
    """`blend_bands` of samples that carry the residual structs."""
    out = {f"{p}_{q}": _where_driver(p, text) for p in POLLUTANTS for q, text in zip(Q, blend_band(p))}
    return rows.withColumns(out).drop(*[f"res_{p}" for p in POLLUTANTS])


def fallback_bands(samples: DataFrame) -> DataFrame:
    """Unrounded bands with the guard failed everywhere."""
    out = {f"{p}_{q}": _where_driver(p, text) for p in POLLUTANTS for q, text in zip(Q, fallback_band(p))}
    return samples.withColumns(out)


def index_quantiles(bands: DataFrame) -> DataFrame:
    """Ordered index quantiles and the category of the median index."""
    raw = {f"aqi_{q}": pm_index(f"pm25_{q}", f"pm10_{q}") for q in Q}
    return aqi_quantile_order(bands.withColumns(raw).withColumn("category", aqi_category("aqi_p50")))


def normal_pairs(n: int = 100, seed: int = 42) -> list[tuple[float, float]]:
    """The fixed joint normal draws every station and lead shares: first n PM2.5, next n PM10."""
    z = np.random.RandomState(seed).standard_normal(2 * n)
    return [(float(a), float(b)) for a, b in zip(z[:n], z[n:])]


BAND_COLUMNS = [f"{p}_{q}" for p in ("pm25", "pm10") for q in Q]


def severe_share(b: str, n: int, seed: int) -> Column:
    """Share of n joint draws whose index is severe, for one struct column of particle bands.

    The draws are one small constant array searched inside the row; nothing is joined.
    """
    draws = ", ".join(f"named_struct('a', {x!r}D, 'b', {y!r}D)" for x, y in normal_pairs(n, seed))

    def drawn(p: str, z: str) -> str:
        sd = f"greatest({MIN_SD!r}D, ({b}.{p}_p90 - {b}.{p}_p10) / {INTERVAL_TO_SD!r}D)"
        return f"CASE WHEN {b}.{p}_p50 IS NOT NULL THEN greatest(0.0D, {b}.{p}_p50 + {sd} * d.{z}) END"

    values = f"transform(array({draws}), d -> named_struct('v25', {drawn('pm25', 'a')}, 'v10', {drawn('pm10', 'b')}))"
    hits = f"size(filter({values}, v -> {pm_index_text('v.v25', 'v.v10')} > {SEVERE_ABOVE}))"
    none = f"{b}.pm25_p50 IS NULL AND {b}.pm10_p50 IS NULL"
    return F.expr(f"CASE WHEN {none} THEN 0.0D ELSE rint({hits} / {float(n)!r}D * 10000.0D) / 10000.0D END")


def with_p_severe(bands: DataFrame, leads=(24, 48, 72), n: int = 100, seed: int = 42) -> DataFrame:
    """Adds `p_severe_<lead>h` to every row of its issue; the largest lead stands in.

    One window over the (at most 72) rows of an issue; only the asked leads are evaluated.
    """
    w = Window.partitionBy("station", "issue_time")
    lead = F.col("lead_h")
    out = bands.withColumn("_last", F.max(lead).over(w)).withColumn("_b", F.struct(*BAND_COLUMNS))
    asked = lead.isin(*leads) | (lead == F.col("_last"))
    out = out.withColumn("_p", F.when(asked, severe_share("_b", n, seed)))

    def at(h: Column) -> Column:
        return F.max(F.when(lead == h, F.col("_p"))).over(w)

    return out.withColumns({
        f"p_severe_{h}h": F.coalesce(at(F.lit(h)), at(F.col("_last"))) for h in leads
    }).drop("_last", "_p", "_b")


def p_severe_mc(bands: DataFrame, leads=(24, 48, 72), n: int = 100, seed: int = 42) -> DataFrame:
    """The severe-risk indicator per (station, issue_time)."""
    names = [f"p_severe_{h}h" for h in leads]
    return with_p_severe(bands, leads, n, seed).groupBy("station", "issue_time").agg(
        *[F.any_value(c).alias(c) for c in names])


def choose_drivers(history: DataFrame, live: DataFrame, issue: Column, max_lead: int = 72) -> DataFrame:
    """Per station: history when it covers every forward hour, the live rows otherwise."""
    def forward(df: DataFrame) -> DataFrame:
        return df.where((F.col("ts") > issue) & (F.col("ts") <= plus_hours(issue, max_lead)))

    ahead = forward(history)
    covered = ahead.groupBy("station").agg(F.count_distinct("ts").alias("_n")).where(F.col("_n") >= max_lead).select("station")
    from_history = ahead.join(covered, "station", "left_semi").withColumn("driver_source", F.lit("history"))
    from_live = forward(live).join(covered, "station", "left_anti").withColumn("driver_source", F.lit("live"))
    return from_history.unionByName(from_live)


def replay_observed(forecast: DataFrame, obs: DataFrame) -> DataFrame:
    """Observed values, index and category at the valid times."""
    seen = targets_at_valid_time(forecast, obs, "obs_")
    return pm_to_aqi(seen, "obs_pm25", "obs_pm10", "obs_aqi", "obs_category")
