"""Rolling bias, lead blend, staleness guard and residual statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.constants import BLEND_WEIGHTS, DEFAULT_WEIGHTS, DRIVER_OF, POLLUTANTS
from hazeline.functions.clock import micros, plus_hours
from hazeline.functions.numeric import exact_avg, greatest_or_null, round_half_even
from hazeline.operators.ordered import DAY_US, HOUR_US, asof_any_age, rolling_mean

WEEK_US = 7 * DAY_US
WEEK_H = 7 * 24


def residual_rows(obs: DataFrame, drivers: DataFrame) -> DataFrame:
    """(station, ts, pollutant, residual) where both observation and driver are present."""
    drv = drivers.select("station", "ts", *[F.col(DRIVER_OF[p]).alias(f"_{p}") for p in POLLUTANTS])
    both = obs.join(drv, ["station", "ts"], "inner")
    return both.select("station", "ts", F.explode(F.array(*[
        F.struct(F.lit(p).alias("pollutant"), (F.col(p) - F.col(f"_{p}")).alias("residual")) for p in POLLUTANTS
    ])).alias("r")).select("station", "ts", "r.*").where("residual IS NOT NULL")


def rolling_bias_7d(obs: DataFrame, drivers: DataFrame, min_periods: int = 6) -> DataFrame:
    """Trailing mean residual over (t - 7 d, t]; null below `min_periods` pairs."""
    return rolling_mean(
        residual_rows(obs, drivers), ["station", "pollutant"], "ts", "residual", "bias_7d", WEEK_US, min_periods)


def bias_asof(issues: DataFrame, bias: DataFrame) -> DataFrame:
    """Last non-null rolling bias at or before issue time, however old; null if none."""
    left = issues.select("station", F.col("issue_time").alias("ts")).withColumn(
        "pollutant", F.explode(F.array(*[F.lit(p) for p in POLLUTANTS])))
    got = asof_any_age(left, bias, ["station", "pollutant"], "ts", {"bias_7d": "bias_7d"})
    return got.withColumnRenamed("ts", "issue_time")


def bias_at_issue(issues: DataFrame, bias: DataFrame) -> DataFrame:
    """`bias_asof` with 0.0 where there is none."""
    return bias_asof(issues, bias).withColumn("bias_7d", F.coalesce("bias_7d", F.lit(0.0)))


def driver_bias_corrected(driver: Column, bias: Column) -> Column:
    """max(0, driver + bias), null when the driver is."""
    return greatest_or_null(F.lit(0.0), driver + bias)


def blend_weight(pollutant: str, lead: Column, weights: dict = BLEND_WEIGHTS) -> Column:
    """Persistence weight of the lead bucket."""
    near, mid, far = weights.get(pollutant, DEFAULT_WEIGHTS)
    return F.when(lead <= 24, near).when(lead <= 48, mid).otherwise(far)


def lead_blend(persistence: Column, corrected: Column, pollutant: str, lead: Column, weights: dict = BLEND_WEIGHTS) -> Column:
    """Weighted mix of persistence and corrected driver; the latter alone if nothing was seen."""
    w = blend_weight(pollutant, lead, weights)
    return F.when(persistence.isNull(), corrected).otherwise(w * persistence + (1.0 - w) * corrected)


def _window_pairs(issues: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of the closed week up to each issue time, whatever minute either falls on.

    Each issue asks for its eight days, met by equality; the exact range is a filter on top.
    """
    last = F.to_date("issue_time")
    asked = issues.select("station", "issue_time").withColumn("_day", F.explode(F.sequence(F.date_sub(last, 7), last)))
    found = asked.join(rows.withColumn("_day", F.to_date("ts")), ["station", "_day"], "inner").drop("_day")
    return found.where(F.col("ts").between(plus_hours("issue_time", F.lit(-WEEK_H)), F.col("issue_time")))


def staleness_guard(issues: DataFrame, obs: DataFrame, min_periods: int = 6) -> DataFrame:
    """Age of the newest observation, valid PM2.5 hours of the closed week, and the status."""
    seen = obs.select("station", "ts", F.when(F.col("pm25").isNotNull(), F.col("ts")).alias("ts25"), F.col("ts").alias("ts_any"))
    left = issues.select("station", F.col("issue_time").alias("ts"))
    newest = asof_any_age(left, seen, ["station"], "ts", {"ts25": "ts25", "ts_any": "ts_any"}).withColumnRenamed("ts", "issue_time")
    counts = _window_pairs(issues, obs.select("station", "ts", "pm25")).groupBy("station", "issue_time").agg(
        F.count("pm25").alias("valid_7d"))
    age = (micros("issue_time") - micros(F.coalesce("ts25", "ts_any"))) / HOUR_US
    out = newest.join(counts, ["station", "issue_time"], "left")
    n = F.coalesce("valid_7d", F.lit(0).cast("long"))
    return out.select(
        "station", "issue_time",
        round_half_even(age, 1).alias("newest_obs_age_hours"),
        n.alias("recent_obs_count_7d"),
        F.when(n >= min_periods, "applied").otherwise("unavailable_no_recent_obs").alias("bias_correction"),
    )


def sorted_percentile(array: str, p: float) -> Column:
    """Linear-interpolated percentile of a short sorted array."""
    at = f"({p!r}D * (size({array}) - 1))"
    lo, hi = f"get({array}, int(floor({at})))", f"get({array}, int(ceil({at})))"
    return F.expr(f"{lo} + ({at} - floor({at})) * ({hi} - {lo})")


def residual_quantiles(issues: DataFrame, obs: DataFrame, drivers: DataFrame, min_periods: int = 6) -> DataFrame:
    """Mean and 10/50/90 % residuals of the closed week per pollutant; a fixed band below 6 pairs.

    A week of residuals per (station, issue, pollutant) fits a sorted array, and the interpolation
    is written out so that its last bit is defined.
    """
    pairs = _window_pairs(issues, residual_rows(obs, drivers))
    stats = pairs.groupBy("station", "issue_time", "pollutant").agg(
        F.count("residual").alias("n"), exact_avg(F.col("residual")).alias("mean"),
        F.sort_array(F.collect_list("residual")).alias("v"),
    )
    spine = issues.select("station", "issue_time").withColumn(
        "pollutant", F.explode(F.array(*[F.lit(p) for p in POLLUTANTS])))
    enough = F.coalesce(F.col("n") >= min_periods, F.lit(False))

    def pick(c: Column, default: float, name: str) -> Column:
        return F.when(enough, c).otherwise(F.lit(default)).alias(name)

    return spine.join(stats, ["station", "issue_time", "pollutant"], "left").select(
        "station", "issue_time", "pollutant", F.coalesce("n", F.lit(0).cast("long")).alias("n_pairs"),
        pick(F.col("mean"), 0.0, "res_mean"), pick(sorted_percentile("v", 0.1), -15.0, "res_p10"),
        pick(sorted_percentile("v", 0.5), 0.0, "res_p50"), pick(sorted_percentile("v", 0.9), 15.0, "res_p90"),
    )
