"""Leakage-free feature tables: issue times, leads, as-of persistence, calendar lags."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeline.constants import (
    DAILY_FEATURES, DRIVER_OF, FEATURES_72H, MET_VARIABLES, POLLUTANTS, SEVERE_INDEX,
    VERY_POOR_INDEX, WINTER_MONTHS,
)
from hazeline.functions.clock import cyclic, micros, plus_hours
from hazeline.functions.numeric import window_avg
from hazeline.operators.ordered import HOUR_US, asof_within, calendar_shift, with_halo

EVENTS = {"severe": SEVERE_INDEX, "very_poor": VERY_POOR_INDEX}


def issue_times(stations: DataFrame, seasons: list[tuple[str, str]], step_h: int, max_lead: int = 72) -> DataFrame:
    """Issue times every `step_h` hours whose whole lead range ends inside the season."""
    grids = []
    for first, last in seasons:
        start = dt.datetime.fromisoformat(first)
        end = dt.datetime.fromisoformat(last) + dt.timedelta(hours=23)
        room = int((end - start).total_seconds() // 3600) - max_lead
        if room >= 0:
            grids.append(_grid(first, room // step_h, step_h))
    every = F.array_distinct(F.flatten(F.array(*grids)))
    return stations.select("station").distinct().withColumn("issue_time", F.explode(every))


def _grid(first: str, steps: int, step_h: int) -> Column:
    start = F.lit(f"{first} 00:00:00").cast("timestamp_ntz")
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: plus_hours(start, k * step_h))


def persistence_24h(issues: DataFrame, obs: DataFrame, pollutants=POLLUTANTS) -> DataFrame:
    """Last value per pollutant at or up to 24 h before the issue time."""
    left = issues.withColumnRenamed("issue_time", "ts")
    got = asof_within(left, obs, ["station"], "ts", {f"last_obs_{p}": p for p in pollutants}, 24 * HOUR_US)
    return got.withColumnRenamed("ts", "issue_time")


def lead_expand(issues: DataFrame, drivers: DataFrame, max_lead: int = 72) -> DataFrame:
    """One row per lead hour that has a driver row.

    An issue asks for the few days its leads reach and meets their hours by equality; what is no whole
    lead is left out on top. The size of exploded issues is estimated without the number of days, so they
    are kept from being broadcast.
    """
    first, last = (F.to_date(plus_hours("issue_time", h)) for h in (1, max_lead))
    asked = issues.withColumn("_day", F.explode(F.sequence(first, last)))
    hours = drivers.withColumnRenamed("ts", "valid_time").withColumn("_day", F.to_date("valid_time"))
    ahead = micros("valid_time") - micros("issue_time")
    met = asked.hint("merge").join(hours, ["station", "_day"], "inner").drop("_day")
    found = met.where((ahead % HOUR_US == 0) & ahead.between(HOUR_US, max_lead * HOUR_US))
    return found.withColumn("lead_h", (ahead / HOUR_US).cast("int"))


def targets_at_valid_time(samples: DataFrame, obs: DataFrame, prefix: str = "target_") -> DataFrame:
    """Observed values at the valid time; null where nothing was observed."""
    seen = obs.select("station", F.col("ts").alias("valid_time"), *[F.col(p).alias(f"{prefix}{p}") for p in POLLUTANTS])
    return samples.join(seen, ["station", "valid_time"], "left")


def ventilation_index(blh: Column, wind_kmh: Column) -> Column:
    """Mixing height times wind in m/s; a missing part counts as zero."""
    zero = F.lit(0.0)
    return F.coalesce(blh, zero) * (F.coalesce(wind_kmh, zero) / 3.6)


def time_features(valid_time: str = "valid_time") -> dict[str, Column]:
    hour, doy = F.hour(valid_time), F.dayofyear(valid_time)
    hs, hc = cyclic(hour, 24.0)
    ds, dc = cyclic(doy, 365.25)
    return {"hour": hour, "hour_sin": hs, "hour_cos": hc, "day_of_year": doy, "doy_sin": ds, "doy_cos": dc}


def hours_ahead(obs: DataFrame, drivers: DataFrame) -> DataFrame:
    """What samples have from their valid time alone: drivers, targets and time features per (station, valid_time)."""
    renamed = [F.col(DRIVER_OF[p]).alias(f"driver_{p}") for p in POLLUTANTS]
    zero = F.lit(0.0)
    hours = targets_at_valid_time(drivers.select("station", F.col("ts").alias("valid_time"), *renamed, *MET_VARIABLES), obs)
    return hours.withColumns(
        {"ventilation_index": ventilation_index(F.col("boundary_layer_height"), F.col("wind_speed_10m"))}
        | time_features()
    ).withColumns({
        "wind_speed_10m": F.coalesce("wind_speed_10m", zero),
        "boundary_layer_height": F.coalesce("boundary_layer_height", zero),
    })


def samples_of_hours(issues: DataFrame, obs: DataFrame, hours: DataFrame, max_lead: int = 72) -> DataFrame:
    """Sample rows of the issues and the `hours_ahead`; further columns of either are kept.

    Whatever belongs to an issue or to an hour is joined to these few rows, before the leads multiply them.
    """
    wide = lead_expand(persistence_24h(issues, obs), hours.withColumnRenamed("valid_time", "ts"), max_lead)
    names = ["station", "issue_time", "valid_time", *FEATURES_72H, *[f"target_{p}" for p in POLLUTANTS]]
    return wide.select(*names, *[c for c in wide.columns if c not in names])


def samples_for_issues(issues: DataFrame, obs: DataFrame, drivers: DataFrame, max_lead: int = 72) -> DataFrame:
    """Feature and target rows of the given (station, issue_time) rows."""
    return samples_of_hours(issues.select("station", "issue_time"), obs, hours_ahead(obs, drivers), max_lead)


def samples_72h(
    obs: DataFrame, drivers: DataFrame, stations: DataFrame, seasons: list[tuple[str, str]],
    step_h: int = 12, max_lead: int = 72,
) -> DataFrame:
    """The full sample matrix of the seasons."""
    return samples_for_issues(issue_times(stations, seasons, step_h, max_lead), obs, drivers, max_lead)


def leak_audit(samples: DataFrame, obs: DataFrame) -> DataFrame:
    """Persistence values that are not the last observation at or before issue time.

    Checks every (station, issue, pollutant) by an independent route: the latest value of the
    closed 24 hours before the issue, met by calendar day and cut to the exact range.
    """
    issues = samples.select("station", "issue_time", *[f"last_obs_{p}" for p in POLLUTANTS]).distinct()
    last = F.to_date("issue_time")
    reach = issues.withColumn("_day", F.explode(F.sequence(F.date_sub(last, 1), last)))
    seen = reach.join(obs.withColumn("_day", F.to_date("ts")), ["station", "_day"], "left")
    inside = F.col("ts").between(plus_hours("issue_time", F.lit(-24)), F.col("issue_time"))
    again = seen.groupBy("station", "issue_time").agg(
        *[F.max(f"last_obs_{p}").alias(f"last_obs_{p}") for p in POLLUTANTS],
        *[F.max_by(p, F.when(inside & F.col(p).isNotNull(), F.col("ts"))).alias(f"check_{p}") for p in POLLUTANTS],
    )
    long = again.select("station", "issue_time", F.explode(F.array(*[
        F.struct(F.lit(p).alias("pollutant"), F.col(f"last_obs_{p}").alias("used"), F.col(f"check_{p}").alias("allowed"))
        for p in POLLUTANTS
    ])).alias("c")).select("station", "issue_time", "c.*")
    return long.where(~F.col("used").eqNullSafe(F.col("allowed")))


def calendar_lag(daily: DataFrame, days: int = 1) -> DataFrame:
    """Index exactly `days` earlier, or null."""
    return calendar_shift(daily.select("station", "date", "aqi"), ["station"], "date", "aqi", {"aqi_lag": -days})


def horizon_labels(daily: DataFrame, horizons=(1, 2, 3), events: dict[str, float] = EVENTS) -> DataFrame:
    """Lag feature, month harmonics and 0/1 event labels; null where the target day is missing."""
    shifts = {"aqi_t_minus_1": -1} | {f"_t{h}": h for h in horizons}
    moved = calendar_shift(daily.select("station", "date", F.col("aqi").alias("aqi_t")), ["station"], "date", "aqi_t", shifts)
    ms, mc = cyclic(F.month("date"), 12.0)
    labels = {
        f"y_{e}_h{h}": F.when(F.col(f"_t{h}").isNotNull(), (F.col(f"_t{h}") >= v).cast("double"))
        for h in horizons for e, v in events.items()
    }
    return moved.withColumns(
        {"year": F.year("date"), "month": F.month("date"), "month_sin": ms, "month_cos": mc} | labels
    ).drop(*[f"_t{h}" for h in horizons])


def contiguous_mean_7d(daily: DataFrame) -> DataFrame:
    """Mean over D-6..D; null unless all seven days are present and positive."""
    base = with_halo(daily.withColumn("_day", F.unix_date("date")), F.col("_day"), 64, 6)
    w = Window.partitionBy("station", "_bucket").orderBy("_day").rangeBetween(-6, 0)
    good = F.when(F.col("aqi") > 0, F.col("aqi"))
    full = F.count(good).over(w) == 7
    return (
        base.withColumn("mean_aqi_7d", F.when(full, window_avg(good, w)))
        .where("_home").drop("_day", "_bucket", "_home")
    )


def pm_ratio(pm10: Column, pm25: Column) -> Column:
    return F.when((pm25 > 0) & (pm10 >= 0), pm10 / pm25)


def daily_features(daily: DataFrame) -> DataFrame:
    """The six daily features; days with any missing or unusable part are left out."""
    lagged = calendar_shift(daily, ["station"], "date", "aqi", {"aqi_d_minus_1": -1})
    ms, mc = cyclic(F.month("date"), 12.0)
    built = contiguous_mean_7d(lagged).withColumns({
        "aqi_d": F.col("aqi"), "pm_ratio": pm_ratio(F.col("pm10"), F.col("pm25")), "month_sin": ms, "month_cos": mc,
    })
    ok = (F.col("aqi_d") > 0) & (F.col("aqi_d_minus_1") > 0)
    for name in DAILY_FEATURES:
        ok = ok & F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(name) != float("inf"))
    return built.where(ok).select("station", "date", *DAILY_FEATURES)


def split_by_year(df: DataFrame, train_years, test_year: int, months=WINTER_MONTHS) -> DataFrame:
    """Adds `part` = train or test for winter rows; rows of other years and months go."""
    if test_year in train_years:
        raise ValueError(f"test year {test_year} is also a training year")
    part = F.when(F.col("year").isin(*train_years), "train").when(F.col("year") == test_year, "test")
    return df.where(F.col("month").isin(*months)).withColumn("part", part).where("part IS NOT NULL")


def split_by_winter(df: DataFrame, train: list[tuple[str, str]], test: tuple[str, str], ts: str = "valid_time") -> DataFrame:
    """Adds `part` by season interval; training seasons must not touch the test season."""
    for first, last in train:
        if not (last < test[0] or first > test[1]):
            raise ValueError(f"training season {first}..{last} overlaps the test season")

    def inside(season):
        return (F.col(ts) >= F.lit(f"{season[0]} 00:00:00").cast("timestamp_ntz")) & (
            F.col(ts) <= F.lit(f"{season[1]} 23:00:00").cast("timestamp_ntz"))

    any_train = F.lit(False)
    for s in train:
        any_train = any_train | inside(s)
    return df.withColumn("part", F.when(any_train, "train").when(inside(test), "test")).where("part IS NOT NULL")
