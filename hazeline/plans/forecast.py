"""The operational 72-hour forecast as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.constants import POLLUTANTS
from hazeline.functions.numeric import round_half_even
from hazeline.operators.bands import Q, index_quantiles, quantile_bands, with_p_severe
from hazeline.operators.bias import residual_quantiles, staleness_guard
from hazeline.operators.boosting import QuantileModels, predict_quantiles
from hazeline.operators.features import samples_for_issues

QUANTILE_NAMES = [f"{p}_{q}" for p in (*POLLUTANTS, "aqi") for q in ("p10", "p50", "p90")]


def forecast_72h(obs: DataFrame, drivers: DataFrame, issues: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Hourly quantiles, index, category and risk for every (station, issue_time) row.

    `drivers` covers the forward hours, `history` (default: the same table) the past week.
    """
    history = drivers if history is None else history
    samples = samples_for_issues(issues, obs, drivers)
    guard = staleness_guard(issues, obs)
    residuals = residual_quantiles(issues, obs, history)
    bands = index_quantiles(quantile_bands(samples, guard, residuals))
    return with_p_severe(bands).select(
        "station", "issue_time", "valid_time", "lead_h", *QUANTILE_NAMES, "category",
        "bias_correction", "newest_obs_age_hours", "recent_obs_count_7d",
        "p_severe_24h", "p_severe_48h", "p_severe_72h",
    )


def forecast_72h_boosted(obs: DataFrame, drivers: DataFrame, issues: DataFrame, models: QuantileModels) -> DataFrame:
    """The same table from boosted models: no residuals and no staleness guard, and no Python in the plan."""
    scored = predict_quantiles(models, samples_for_issues(issues, obs, drivers), native=True)
    rounded = scored.withColumns({f"{p}_{q}": round_half_even(F.col(f"{p}_{q}"), 1) for p in POLLUTANTS for q in Q})
    return with_p_severe(index_quantiles(rounded)).select(
        "station", "issue_time", "valid_time", "lead_h", *QUANTILE_NAMES, "category",
        F.lit("not_applicable").alias("bias_correction"), F.lit(None).cast("double").alias("newest_obs_age_hours"),
        F.lit(0).cast("long").alias("recent_obs_count_7d"),
        "p_severe_24h", "p_severe_48h", "p_severe_72h",
    )


def forecast_documents(forecast: DataFrame, stations: DataFrame) -> DataFrame:
    """One nested document per issue and station: ordered hours (at most 72), risk, guard."""
    def band(name: str):
        return F.struct(*[F.col(f"{name}_{q}").alias(q) for q in ("p10", "p50", "p90")]).alias(
            "aqi_pm" if name == "aqi" else name)

    hour = F.struct("lead_h", "valid_time", *[band(p) for p in (*POLLUTANTS, "aqi")], "category")
    docs = forecast.groupBy("issue_time", "station").agg(
        F.sort_array(F.collect_list(hour)).alias("hourly"),
        F.any_value("bias_correction").alias("bias_correction"),
        F.any_value("newest_obs_age_hours").alias("newest_obs_age_hours"),
        F.any_value("recent_obs_count_7d").alias("recent_obs_count_7d"),
        F.struct(*[F.any_value(f"p_severe_{h}h").alias(f"{h}h") for h in (24, 48, 72)]).alias("p_severe"),
    )
    return docs.join(stations, "station", "left")


def forecast_json(forecast: DataFrame, stations: DataFrame) -> DataFrame:
    """The documents as JSON text, null fields kept."""
    docs = forecast_documents(forecast, stations)
    body = F.to_json(F.struct(*[c for c in docs.columns]), {"ignoreNullFields": "false"})
    return docs.select("issue_time", "station", F.size("hourly").alias("n_hours"), body.alias("document"))


def forecast_rows(docs: DataFrame) -> DataFrame:
    """The reverse of `forecast_documents`: one row per hour, with the document's number of hours."""
    rows = docs.withColumn("n_hours", F.size("hourly").cast("long")).withColumn("h", F.explode("hourly"))
    bands = [F.col(f"h.{'aqi_pm' if p == 'aqi' else p}.{q}").alias(f"{p}_{q}") for p in (*POLLUTANTS, "aqi") for q in ("p10", "p50", "p90")]
    return rows.select(
        "station", F.col("name").alias("station_name"), "issue_time", "h.valid_time", "h.lead_h", *bands, "h.category",
        "bias_correction", "newest_obs_age_hours", "recent_obs_count_7d",
        *[F.col(f"p_severe.{h}h").alias(f"p_severe_{h}h") for h in (24, 48, 72)], "n_hours")
