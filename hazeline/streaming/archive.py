"""Incremental archives: file streams that take what has landed since the last run and stop.

The de-duplication key is the identity of a row, so no watermark is involved: a late file is
archived whenever it arrives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.functions.clock import micros
from hazeline.operators.ordered import HOUR_US
from hazeline.sources.sinks import append_observations, write_cycle

CYCLE_SCHEMA = (
    "station string, issue_time timestamp_ntz, ts timestamp_ntz, pm2_5 double, pm10 double, ozone double, "
    "nitrogen_dioxide double, temperature_2m double, relative_humidity_2m double, wind_speed_10m double, "
    "wind_direction_10m double, boundary_layer_height double, surface_pressure double"
)
READING_SCHEMA = "station string, ts timestamp_ntz, pm25 double, pm10 double, o3 double, no2 double, source string"


def stream_cycles(spark: SparkSession, landing: str, archive: str, checkpoint: str, schema: str = CYCLE_SCHEMA):
    """Archive every newly landed driver file as its forecast cycle (lead >= 1), then stop.

    Landed rows carry their issue time, so one run can take several cycles at once.
    """
    rows = spark.readStream.schema(schema).parquet(landing)
    lead = F.rint((micros("ts") - micros("issue_time")) / HOUR_US).cast("int")
    cycle = rows.withColumn("lead_h", lead).where("lead_h >= 1").withColumnRenamed("ts", "valid_time").withColumn(
        "issue_date", F.to_date("issue_time"))
    query = (
        cycle.writeStream.format("parquet").partitionBy("issue_date").outputMode("append")
        .option("path", archive).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def stream_observations(spark: SparkSession, landing: str, archive: str, checkpoint: str, schema: str = READING_SCHEMA):
    """Append landed readings whose (station, ts) is not archived yet, then stop.

    A batch that is repeated after a failure finds its own rows archived and adds nothing.
    """
    def upsert(batch: DataFrame, _: int) -> None:
        append_observations(batch.sparkSession, batch, archive)

    query = (
        spark.readStream.schema(schema).parquet(landing).writeStream.foreachBatch(upsert)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def archive_batch(cycle: DataFrame, path: str, save_format: str = "parquet") -> None:
    """Batch form of `stream_cycles`."""
    write_cycle(cycle, path, save_format)
