"""Counts of satellite fire detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.functions.clock import utc_hhmm_to_local_hour


def fires_by_year(fires: DataFrame, months=(10, 11)) -> DataFrame:
    """Detections per year in the given months; unreadable dates are dropped."""
    day = F.col("acq_date").try_cast("date")
    return (
        fires.select(day.alias("d")).where(F.month("d").isin(*months))
        .groupBy(F.year("d").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    )


def overpass_histogram(fires: DataFrame) -> DataFrame:
    """Detections per local hour 0..23, zeros included.

    The 24 counts are conditional sums of one aggregate, so no spine is joined.
    """
    hour = fires.where("acq_time IS NOT NULL").select(utc_hhmm_to_local_hour("acq_time").alias("h"))
    one = hour.agg(*[F.count_if(F.col("h") == k).alias(str(k)) for k in range(24)])
    return one.unpivot([], [str(k) for k in range(24)], "hour", "n").withColumn("hour", F.col("hour").cast("int"))


def fires_by_confidence(fires: DataFrame) -> DataFrame:
    """Detections per confidence class, missing class left out."""
    return fires.where("confidence IS NOT NULL").groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))
