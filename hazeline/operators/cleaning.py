"""Cleaning of hourly and sub-hourly series. Nothing here fills or interpolates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeline.constants import HOURLY_VALUES, NA_TOKENS, READING_ALIASES
from hazeline.functions.clock import hour_floor
from hazeline.functions.numeric import exact_avg, nan_to_null
from hazeline.operators.ordered import first_rows


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text to double per column; NA tokens and unreadable text become null, absent columns too."""
    out = {}
    for name in columns:
        if name in df.columns:
            text = F.trim(F.col(name).cast("string"))
            clean = F.when(~text.isin(*NA_TOKENS) & text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text)
            out[name] = nan_to_null(clean.try_cast("double"))
        else:
            out[name] = F.lit(None).cast("double")
    return df.withColumns(out)


def flag_capped(df: DataFrame, col: str = "pm10", cap: float = 1000.0) -> DataFrame:
    """Marks saturated values; the value itself stays."""
    return df.withColumn(f"{col}_capped", F.coalesce(F.col(col) == cap, F.lit(False)))


def align_minute00(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Keep periods that start on the clock hour."""
    return df.where(F.minute(ts) == 0)


def coverage_filter(df: DataFrame, min_pct: float = 75.0, col: str = "coverage") -> DataFrame:
    """Drop records below the coverage; missing coverage passes."""
    return df.where(F.col(col).isNull() | (F.col(col) >= min_pct))


def drop_exact_dups(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys).distinct()


def hour_records_clean(df: DataFrame, keys: list[str], ts: str = "ts", min_pct: float = 75.0) -> DataFrame:
    """Raw hour records to a clean series: on the hour, covered, without exact copies."""
    kept = df.where(F.col("value").isNotNull() & F.col(ts).isNotNull())
    return drop_exact_dups(coverage_filter(align_minute00(kept, ts), min_pct), [*keys, ts, "value"])


def subhourly_to_hourly(
    df: DataFrame, keys: list[str], ts: str = "ts", min_samples: int = 3, adaptive: bool = True
) -> DataFrame:
    """Hourly means of sub-hourly readings.

    With `adaptive`, a series that ever has 4 samples in an hour needs `min_samples` per
    hour; coarser series need one. The window sees one row per calendar hour and series.
    """
    hourly = (
        drop_exact_dups(df, [*keys, ts, "value"])
        .groupBy(*keys, hour_floor(ts).alias(ts))
        .agg(F.count("value").alias("n_samples"), exact_avg(F.col("value")).alias("value"))
    )
    if not adaptive:
        return hourly.where(F.col("n_samples") >= min_samples)
    finest = F.max("n_samples").over(Window.partitionBy(*keys))
    needed = F.when(finest >= 4, min_samples).otherwise(1)
    return hourly.withColumn("_need", needed).where("n_samples >= _need").drop("_need")


def long_to_wide(df: DataFrame, keys: list[str], params: list[str], order: str) -> DataFrame:
    """One column per parameter; of several values for the same key the last in `order` wins."""
    def last_value(p: str) -> Column:
        here = (F.col("parameter") == p) & F.col("value").isNotNull()
        return F.max_by(F.when(here, F.col("value")), F.when(here, F.col(order))).alias(p)

    return df.where(F.col("parameter").isin(*params)).groupBy(*keys).agg(*[last_value(p) for p in params])


def pm_outer_merge(pm25: DataFrame, pm10: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer merge of two series; differing values for one key fan out as in any join."""
    return pm25.join(pm10, keys, "full")


def conform_layout(df: DataFrame, source: str) -> DataFrame:
    """The 16-column hourly layout, with absent columns as null."""
    cols = [F.col("ts"), F.col("station"), F.lit(source).alias("source")]
    for name in HOURLY_VALUES:
        cols.append(F.col(name).cast("double").alias(name) if name in df.columns else F.lit(None).cast("double").alias(name))
    return flag_capped(df.select(*cols))


def merge_sources(primary: DataFrame, secondary: DataFrame, keys: list[str], fill: list[str]) -> DataFrame:
    """Full outer merge; `fill` columns take the second source where the first is missing."""
    other = secondary.select(*keys, *[F.col(c).alias(f"_{c}") for c in fill])
    merged = primary.join(other, keys, "full")
    return merged.withColumns({c: F.coalesce(c, f"_{c}") for c in fill}).select(*primary.columns)


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row per key in an explicit order."""
    return first_rows(df, keys, order)


def latest_readings(df: DataFrame) -> DataFrame:
    """One row per station from its latest-reading list: pollutant columns and newest time.

    Expects station, parameter, value, ts, position; unknown parameters only count for the
    time, a repeated parameter takes its last list element.
    """
    name = F.lower(F.trim(F.col("parameter")))

    def pick(target: str) -> Column:
        spellings = [s for s, t in READING_ALIASES.items() if t == target]
        here = name.isin(*spellings)
        return F.max_by(
            F.when(here, F.struct(F.col("value").alias("v"))), F.when(here, F.col("position"))
        )["v"].alias(target)

    return df.groupBy("station").agg(
        F.max("ts").alias("ts"), *[pick(p) for p in ("pm25", "pm10", "o3", "no2")]
    ).where("ts IS NOT NULL")


def duplicate_series(df: DataFrame, value: str = "pm25") -> DataFrame:
    """Stations whose value series equals another station's in the same year.

    Compares values in time order, missing equal to missing. Needs one row per station and
    hour (so a station-year is at most 8,784 rows). Each copy is reported once, against the
    first station of its set, so a large set of copies stays linear. Digests only nominate;
    a row-by-row comparison confirms.
    """
    w = Window.partitionBy("station", "year").orderBy("ts")
    numbered = df.select("station", F.year("ts").alias("year"), "ts", F.col(value).alias("v")).withColumn(
        "rn", F.row_number().over(w)
    )
    digests = numbered.groupBy("year", "station").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.bit_xor(F.xxhash64("rn", "v")).alias("d1"),
        F.bit_xor(F.xxhash64("v", "rn", F.lit("b"))).alias("d2"),
    )
    heads = digests.groupBy("year", "n_rows", "d1", "d2").agg(
        F.min("station").alias("same_as"), F.count(F.lit(1)).alias("copies")
    ).where("copies > 1").drop("copies")
    nominated = digests.join(heads, ["year", "n_rows", "d1", "d2"]).where(
        "station <> same_as"
    ).select("year", "station", "same_as", "n_rows")
    mine = numbered.join(nominated, ["year", "station"]).select("year", "station", "same_as", "n_rows", "rn", "v")
    head = numbered.select("year", F.col("station").alias("same_as"), "rn", F.col("v").alias("head_v"))
    return (
        mine.join(head, ["year", "same_as", "rn"])
        .groupBy("year", "station", "same_as", "n_rows")
        .agg(F.count_if(F.col("v").eqNullSafe(F.col("head_v"))).alias("equal_rows"))
        .where("equal_rows = n_rows")
        .select("year", "station", "same_as", "n_rows")
    )


def season_filter(df: DataFrame, ts: str, start, end, closed: str = "both") -> DataFrame:
    """Rows of [start, end] or, with closed='left', [start, end); a plain pushable comparison."""
    upper = F.col(ts) < F.lit(end) if closed == "left" else F.col(ts) <= F.lit(end)
    return df.where((F.col(ts) >= F.lit(start)) & upper)
