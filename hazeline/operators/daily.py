"""Daily means, daily index tables and index checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.constants import (
    CATEGORIES, CONC_BANDS, INDEX_NAMES, SEVERE_INDEX, VERY_POOR_INDEX, breakpoint_rows,
)
from hazeline.functions.clock import reporting_date
from hazeline.functions.index import aqi_category, aqi_max, is_severe, pm_index, sub_index
from hazeline.functions.numeric import exact_avg


def unpivot(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """(ids, pollutant, value) rows."""
    return df.unpivot(ids, columns, "pollutant", "value")


def band_counts(long: DataFrame) -> DataFrame:
    """Rows inside each concentration band (values in a gap or beyond the top count nowhere)."""
    arms = " ".join(
        f"WHEN pollutant = '{name}' AND value BETWEEN {float(lo)!r}D AND {float(hi)!r}D THEN '{cat}'"
        for name, bands in CONC_BANDS.items() for (lo, hi), cat in zip(bands, CATEGORIES)
    )
    inside = long.withColumn("category", F.expr(f"CASE {arms} END")).where("category IS NOT NULL")
    return inside.groupBy("pollutant", "category").agg(F.count(F.lit(1)).alias("n_hours"))


def threshold_hits(daily: DataFrame) -> DataFrame:
    """Station-days at or above the two alert thresholds."""
    one = daily.agg(
        F.count_if(F.col("aqi") >= SEVERE_INDEX).alias("Severe"),
        F.count_if(F.col("aqi") >= VERY_POOR_INDEX).alias("Very Poor or worse"),
    )
    return one.unpivot([], ["Severe", "Very Poor or worse"], "event", "n_days")


def daily_average(
    df: DataFrame, columns: list[str], min_valid_hours: int = 16, ts: str = "ts", counts: list[str] = ()
) -> DataFrame:
    """16:00-to-16:00 daily means; null below the minimum of valid hours, rows kept."""
    return df.groupBy("station", reporting_date(ts).alias("date")).agg(
        *[F.when(F.count(c) >= min_valid_hours, exact_avg(F.col(c))).alias(c) for c in columns],
        *[F.count(c).alias(f"n_{c}") for c in counts],
    )


def daily_aqi_7(hourly: DataFrame, min_valid_hours: int = 16) -> DataFrame:
    """Daily means of seven pollutants and their index (the 24 h mean is used for all)."""
    names = list(INDEX_NAMES)
    have = [n for n in names if n in hourly.columns]
    d = daily_average(hourly, have, min_valid_hours)
    d = d.withColumns({n: F.lit(None).cast("double") for n in names if n not in have})
    index = aqi_max(*[sub_index(INDEX_NAMES[n], n) for n in have])
    return d.select("station", "date", index.alias("aqi"), *[F.col(n).alias(f"conc_{n}") for n in names])


def daily_aqi_pm(hourly: DataFrame, min_valid_hours: int = 16) -> DataFrame:
    """Daily particle means and their index."""
    d = daily_average(hourly, ["pm25", "pm10"], min_valid_hours)
    return d.withColumn("aqi", pm_index("pm25", "pm10"))


def daily_calendar(daily: DataFrame, first: str, last: str) -> DataFrame:
    """One row per station and calendar day; days without data stay null."""
    spine = daily.select("station").distinct().withColumn(
        "date", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 day"))))
    out = spine.join(daily.select("station", "date", "pm25", "pm10", "aqi"), ["station", "date"], "left")
    return out.withColumn("category", F.when(F.col("aqi").isNotNull(), aqi_category("aqi")))


def category_counts(calendar: DataFrame) -> DataFrame:
    """Days per category and station, zeros included."""
    return calendar.groupBy("station").agg(*[F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES])


def p_severe_samples(samples: DataFrame, by: list[str]) -> DataFrame:
    """Share of joint samples with a severe index; pairs without any value do not count."""
    index = pm_index("pm25", "pm10")
    s = samples.select(*by, index.alias("_i"))
    return s.groupBy(*by).agg(
        F.coalesce(F.try_divide(F.count_if(is_severe("_i")).cast("double"), F.count("_i")), F.lit(0.0)).alias("p_severe"),
        F.count("_i").alias("n_valid"),
    )


def index_selfcheck(stored: DataFrame) -> DataFrame:
    """Mismatches between stored index/category and the index looked up in the band rows.

    The lookup searches the 42 rows as an array value, so the check does not share the CASE
    chain that produced the stored values.
    """
    rows = ", ".join(
        f"named_struct('name', '{n}', 'a', {a!r}D, 'b', {b!r}D, 'i', {i!r}D, 'j', {j!r}D)"
        for n, _, a, b, i, j, _ in sorted(breakpoint_rows())
    )

    def lookup(name: str, conc: str) -> Column:
        mine = f"filter(array({rows}), r -> r.name = '{name}')"
        hit = f"filter({mine}, r -> r.a <= {conc} AND {conc} <= r.b)"
        band = f"coalesce(get({hit}, 0), element_at({mine}, -1))"
        value = f"transform(array({band}), r -> rint(r.i + (r.j - r.i) / (r.b - r.a) * ({conc} - r.a)))[0]"
        return F.expr(f"CASE WHEN {conc} >= 0 THEN {value} END")

    again = stored.withColumn(
        "_again", aqi_max(lookup("PM2.5", "pm25"), lookup("PM10", "pm10")))
    return again.groupBy("station").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.col("aqi").eqNullSafe(F.col("_again"))).cast("int").alias("n_bad_index"),
        F.count_if(~F.col("category").eqNullSafe(aqi_category("_again"))).cast("int").alias("n_bad_category"),
        F.count("aqi").alias("n_index"),
    )


def aqi_quantile_order(df: DataFrame) -> DataFrame:
    """p10 >= 0, p50 >= p10, p90 >= p50; a missing quantile takes the one below."""
    p10 = F.greatest(F.lit(0.0), F.coalesce("aqi_p10", F.lit(0.0)))
    p50 = F.greatest(p10, F.coalesce("aqi_p50", p10))
    p90 = F.greatest(p50, F.coalesce("aqi_p90", p50))
    return df.withColumns({"aqi_p10": p10, "aqi_p50": p50, "aqi_p90": p90})
