"""Completeness and continuity reports over hourly tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.constants import POLLUTANTS
from hazeline.functions.clock import micros, reporting_date, winter_label
from hazeline.functions.numeric import exact_avg, round_half_even
from hazeline.operators.ordered import HOUR_US, previous_time


def pct(part: Column, whole: Column, digits: int) -> Column:
    return round_half_even(part / whole * 100, digits)


def _unique_times(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    counted = df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("copies"))
    return previous_time(counted, keys, ts, "previous")


def gap_rows(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Timestamps that follow a gap of more than one hour."""
    rows = _unique_times(df.select("station", ts), ["station"], ts)
    hours = (micros(ts) - micros("previous")) / HOUR_US
    return rows.withColumn("gap_hours", hours).where("gap_hours > 1").select("station", ts, "gap_hours")


def continuity_audit(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Per station: duplicate timestamps (all but the first) and gaps over one hour."""
    rows = _unique_times(df.select("station", ts), ["station"], ts)
    return rows.groupBy("station").agg(
        F.sum(F.col("copies") - 1).alias("duplicates"),
        F.count_if(micros(ts) - micros("previous") > HOUR_US).alias("gaps"),
    )


def station_report(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Quality report per station plus the grand total (station null).

    One pass per (station, time) keeps counts; continuity comes from the same small table.
    """
    per_time = df.groupBy("station", ts).agg(
        F.count(F.lit(1)).alias("copies"),
        F.count_if(F.col("pm25").isNull()).alias("no25"),
        F.count_if(F.col("pm10").isNull()).alias("no10"),
        F.count_if(F.col("pm10") == 1000).alias("capped"),
    )
    rows = previous_time(per_time, ["station"], ts, "previous")
    gap = micros(ts) - micros("previous") > HOUR_US
    report = rows.rollup("station").agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        F.sum("copies").alias("n_rows"),
        F.sum("no25").alias("pm25_missing"), F.sum("no10").alias("pm10_missing"),
        F.sum("capped").alias("pm10_capped_hours"),
        F.sum(F.col("copies") - 1).alias("duplicates"), F.count_if(gap).alias("gaps"),
    )
    return report.withColumns({
        "pm25_missing_pct": pct(F.col("pm25_missing"), F.col("n_rows"), 2),
        "pm10_missing_pct": pct(F.col("pm10_missing"), F.col("n_rows"), 2),
    })


def raw_inspection(records: DataFrame, keys: list[str], ts: str = "ts", order: str = "file_order") -> DataFrame:
    """Per series and month: records, duplicate timestamps, median gap (minutes), an example."""
    month = F.date_format(ts, "yyyy-MM")
    by = [*keys, "month"]
    rows = records.withColumn("month", month)
    per_time = rows.groupBy(*by, ts).agg(
        F.count(F.lit(1)).alias("copies"), F.min_by("value", order).alias("value"), F.min(order).alias("first")
    )
    timed = previous_time(per_time, by, ts, "previous").withColumn(
        "gap", (micros(ts) - micros("previous")) / 60_000_000
    )
    return timed.groupBy(*by).agg(
        F.sum("copies").alias("n_records"),
        F.sum(F.col("copies") - 1).alias("duplicates"),
        F.percentile("gap", 0.5).alias("median_gap_min"),
        F.min_by("value", "first").alias("example_value"),
    )


def monthly_coverage(df: DataFrame, first_month: str, last_month: str, min_valid_hours: int = 16) -> DataFrame:
    """Coverage over a complete station x month spine; absent months count zero.

    A reporting day is cut at the month's ends, so its hours are counted per month.
    """
    spine = df.select("station").distinct().withColumn(
        "month_start",
        F.explode(F.sequence(F.lit(first_month).cast("date"), F.lit(last_month).cast("date"), F.expr("interval 1 month"))),
    )
    per_day = df.groupBy(
        "station", F.trunc(F.to_date("ts"), "month").alias("month_start"), reporting_date("ts").alias("rep_date")
    ).agg(F.count("pm25").alias("h25"), F.count("pm10").alias("h10"))
    per_month = per_day.groupBy("station", "month_start").agg(
        F.sum("h25").alias("h25"), F.sum("h10").alias("h10"),
        F.count_if(F.col("h25") >= min_valid_hours).alias("days"),
    )
    days = F.day(F.last_day("month_start"))
    zero = F.lit(0).cast("long")
    return spine.join(per_month, ["station", "month_start"], "left").select(
        "station",
        F.date_format("month_start", "yyyy-MM").alias("month"),
        (days * 24).alias("hours_possible"),
        F.coalesce("h25", zero).alias("valid_pm25"),
        F.coalesce("h10", zero).alias("valid_pm10"),
        pct(F.coalesce("h25", zero), days * 24, 1).alias("pm25_pct"),
        pct(F.coalesce("h10", zero), days * 24, 1).alias("pm10_pct"),
        F.coalesce("days", zero).alias("passing_days"),
        days.alias("days_in_month"),
    )


def winter_means(df: DataFrame, seasons: list[str] | None = None, ts: str = "ts", value: str = "pm25") -> DataFrame:
    """Count, mean and sample deviation per winter and station."""
    labelled = df.where(F.col(value).isNotNull()).withColumn("winter", winter_label(ts))
    kept = labelled.where(F.col("winter").isin(*seasons)) if seasons else labelled.where("winter <> 'Other'")
    return kept.groupBy("winter", "station").agg(
        F.count(value).alias("valid_hours"),
        round_half_even(exact_avg(F.col(value)), 2).alias("mean_value"),
        round_half_even(F.stddev_samp(value), 2).alias("std_value"),
    )


def winter_audit(df: DataFrame, stations: DataFrame, winters: list[tuple[str, str, str]]) -> DataFrame:
    """Valid and missing hours per winter, station and pollutant; empty cells are zero.

    `winters` holds (name, first day, last day); the last day counts to 23:00.
    """
    table = F.array(*[
        F.struct(
            F.lit(n).alias("winter"),
            F.lit(f"{a} 00:00:00").cast("timestamp_ntz").alias("t0"),
            F.lit(f"{b} 23:00:00").cast("timestamp_ntz").alias("t1"),
        ) for n, a, b in winters
    ])
    spine = stations.select("station").distinct().withColumn("w", F.explode(table)).select("station", "w.*")
    hours = (F.timestamp_diff("HOUR", F.col("t0"), F.col("t1")) + 1).alias("calendar_hours")
    label = F.lit(None).cast("string")
    for n, a, b in winters:
        inside = (F.col("ts") >= F.lit(f"{a} 00:00:00").cast("timestamp_ntz")) & (
            F.col("ts") <= F.lit(f"{b} 23:00:00").cast("timestamp_ntz"))
        label = F.when(inside, n).otherwise(label)
    counts = df.withColumn("winter", label).where("winter IS NOT NULL").groupBy("station", "winter").agg(
        *[F.count(p).alias(p) for p in POLLUTANTS]
    )
    wide = spine.select("station", "winter", hours).join(counts, ["station", "winter"], "left")
    long = wide.select(
        "station", "winter", "calendar_hours",
        F.explode(F.array(*[
            F.struct(F.lit(p).alias("pollutant"), F.coalesce(F.col(p), F.lit(0).cast("long")).alias("valid_hours"))
            for p in POLLUTANTS
        ])).alias("c"),
    ).select("station", "winter", "calendar_hours", "c.*")
    missing = F.col("calendar_hours") - F.col("valid_hours")
    return long.withColumns({
        "missing_hours": missing,
        "valid_pct": pct(F.col("valid_hours"), F.col("calendar_hours"), 1),
        "missing_pct": pct(missing, F.col("calendar_hours"), 1),
    })


def season_windows(seasons: DataFrame) -> DataFrame:
    """Five monthly windows (Oct-Feb, leap February included) per season start year."""
    start = F.make_date("start_year", F.lit(10), F.lit(1))
    return seasons.select(
        "start_year",
        F.explode(F.sequence(start, F.add_months(start, 4), F.expr("interval 1 month"))).alias("window_from"),
    ).select(
        F.concat_ws("-", F.col("start_year").cast("string"), (F.col("start_year") + 1).cast("string")).alias("season"),
        "window_from",
        F.add_months("window_from", 1).alias("window_to"),
        F.day(F.last_day("window_from")).alias("n_days"),
    )


def date_chunks(years: DataFrame, days: int = 5) -> DataFrame:
    """Fixed-length windows over 1 Oct .. 30 Nov of each year, the last one shorter."""
    first = F.make_date("year", F.lit(10), F.lit(1))
    last = F.make_date("year", F.lit(11), F.lit(30))
    return years.select(
        "year", last.alias("_last"),
        F.explode(F.sequence(first, last, F.expr(f"interval {days} day"))).alias("window_from"),
    ).select(
        "year", "window_from", F.least(F.lit(days), F.datediff("_last", "window_from") + 1).alias("n_days")
    )


def window_overlap(sensors: DataFrame, first_season: int, last_season: int) -> DataFrame:
    """For each sensor and seasonal month window: skip or not, and why.

    The windows are calendar months generated per sensor row, not a joined table. An open
    bound (null) never skips.
    """
    starts = F.sequence(F.lit(first_season), F.lit(last_season))
    windows = F.flatten(F.transform(
        starts,
        lambda y: F.transform(
            F.sequence(F.lit(0), F.lit(4)), lambda k: F.add_months(F.make_date(y, F.lit(10), F.lit(1)), k)
        ),
    ))
    w = sensors.withColumn("window_from", F.explode(windows)).withColumn("window_to", F.add_months("window_from", 1))
    early = F.coalesce(F.col("window_to") <= F.col("first_date"), F.lit(False))
    late = F.coalesce(F.col("window_from") >= F.col("last_date"), F.lit(False))
    return w.withColumn("skip", early | late).withColumn(
        "reason", F.when(early, "window ends before the sensor's first reading")
        .when(late, "window starts after the sensor's last reading")
    )
