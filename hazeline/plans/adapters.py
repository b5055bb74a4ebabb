"""Views that read the given star-schema tables as stations, drivers, soundings and fires.

Only the columns a view needs are selected, so the Parquet scan prunes the rest. Averages
are sums of whole cents divided once, so that they do not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.constants import breakpoint_rows
from hazeline.functions.clock import hour_floor, minute_floor, plus_hours, utc_to_local
from hazeline.functions.numeric import exact_avg

T0 = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"
BREAKPOINT_SCHEMA = (
    "pollutant string, averaging_hours int, conc_low double, conc_high double, "
    "index_low double, index_high double, category string"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def davg(c: Column) -> Column:
    return exact_avg(c, 2)


#: Neighbouring keys share a station, so that stations grow with the tables and hours stay as full.
KEYS_PER_STATION = {"user_id": 50, "l_suppkey": 34, "s_suppkey": 34, "o_custkey": 500}


def _station(c: str) -> Column:
    return F.concat(F.lit("st"), F.expr(f"{c} div {KEYS_PER_STATION[c]}").cast("string"))


def obs(spark, sf_dir) -> DataFrame:
    """Hourly observations from `events`."""
    e = table(spark, sf_dir, "events").select("ts", "user_id", "event_type", "value", "props")
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.groupBy(_station("user_id").alias("station"), hour_floor("ts").alias("ts")).agg(
        (4 * davg(F.when(kind.isin("click", "view"), F.col("value")))).alias("pm25"),
        (6 * davg(F.when(kind.isin("purchase", "signup"), F.col("value")))).alias("pm10"),
        davg(F.when(kind == "error", F.col("value"))).alias("no2"),
        davg(F.when(kind == "error", k)).alias("o3"),
    )


def drivers(spark, sf_dir) -> DataFrame:
    """Hourly gridded drivers from `lineitem`."""
    li = table(spark, sf_dir, "lineitem")
    ts = plus_hours(F.expr(T0), (F.col("l_orderkey") % 720).cast("int"))
    q, p, n = davg(F.col("l_quantity")), davg(F.col("l_extendedprice")), davg(F.col("l_linenumber"))
    return li.groupBy(_station("l_suppkey").alias("station"), ts.alias("ts")).agg(
        (6 * q).alias("pm2_5"),
        (p / 200).alias("pm10"),
        (1000 * davg(F.col("l_tax"))).alias("ozone"),
        (800 * davg(F.col("l_discount"))).alias("nitrogen_dioxide"),
        (5 * n).alias("temperature_2m"),
        (12 * n).alias("relative_humidity_2m"),
        (q / 3).alias("wind_speed_10m"),
        (50 * n).alias("wind_direction_10m"),
        (p / 60).alias("boundary_layer_height"),
        (1000 + n).alias("surface_pressure"),
    )


def daily_long(spark, sf_dir) -> DataFrame:
    """Daily index and particle means per station from `orders` (natural gaps)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return o.groupBy(_station("o_custkey").alias("station"), F.to_date("o_orderdate").alias("date")).agg(
        (davg(F.col("o_totalprice")) / 1000).alias("aqi"),
        (davg(F.col("o_custkey") % 300) + 1).alias("pm25"),
        davg(F.col("o_orderkey") % 500).alias("pm10"),
    )


def soundings(spark, sf_dir) -> DataFrame:
    """Vertical profiles from `lineitem`: one level per (part, order)."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_quantity")
    return li.groupBy(F.col("l_partkey").alias("profile"), F.col("l_orderkey").cast("double").alias("height_m")).agg(
        davg(F.col("l_quantity")).alias("temp_c")
    )


def raw_soundings(spark, sf_dir) -> DataFrame:
    """The levels before merging: a height may repeat inside a profile."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("profile"),
        F.col("l_orderkey").cast("double").alias("height_m"),
        F.col("l_quantity").alias("temp_c"),
        F.col("l_orderkey").alias("o1"), F.col("l_linenumber").alias("o2"),
        F.col("l_suppkey").alias("o3"), F.col("l_quantity").alias("o4"), F.col("l_extendedprice").alias("o5"),
    )


def fires(spark, sf_dir) -> DataFrame:
    """Fire detections from `orders`."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"
    )
    return o.select(
        (28 + (F.col("o_custkey") % 100) * F.lit(0.06)).alias("latitude"),
        (72 + (F.col("o_orderkey") % 100) * F.lit(0.07)).alias("longitude"),
        F.to_date("o_orderdate").alias("acq_date"),
        ((F.col("o_orderkey") % 24) * 100 + F.col("o_custkey") % 60).cast("int").alias("acq_time"),
        F.col("o_orderpriority").alias("confidence"),
        (F.col("o_totalprice") / 10000).alias("frp"),
    )


def joint_samples(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice")
    return li.select(
        F.col("l_suppkey").alias("group_id"),
        (8 * F.col("l_quantity")).alias("pm25"),
        (F.col("l_extendedprice") / 150).alias("pm10"),
    )


def outcomes(spark, sf_dir) -> DataFrame:
    """Event outcomes `y` with forecast probabilities `p` from `lineitem`."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax", "l_returnflag"
    )
    return li.select(
        _station("l_suppkey").alias("station"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"),
        (F.col("l_discount") * 10).alias("p"),
        (F.col("l_tax") * 10).alias("ref"),
        F.col("l_orderkey").alias("o1"), F.col("l_linenumber").alias("o2"),
        F.col("l_partkey").alias("o3"), F.col("l_suppkey").alias("o4"),
    )


def hour_records(spark, sf_dir) -> DataFrame:
    """Overlapping half-hour sensor records from `events`; `ts` is local time."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return e.select(
        _station("user_id").alias("station"),
        F.col("event_type").alias("parameter"),
        utc_to_local(minute_floor("ts", 30)).alias("ts"),
        F.col("value"),
        (60 + F.col("event_id") % 41).cast("double").alias("coverage"),
        F.col("event_id").alias("file_order"),
    )


def stations(spark, sf_dir) -> DataFrame:
    """Station registry from `supplier`: the stations of the other views."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return s.groupBy(_station("s_suppkey").alias("station")).agg(
        F.min("s_name").alias("name"),
        (28 + davg(F.col("s_acctbal")) / 10000).alias("lat"),
        (77 + davg(F.col("s_acctbal")) / 20000).alias("lon"),
    )


def locations(spark, sf_dir) -> DataFrame:
    """Candidate locations with coordinates from `customer`."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", "c_acctbal")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.concat_ws(" ", F.col("c_mktsegment"), F.col("c_name")).alias("name"),
        (28 + (F.col("c_custkey") % 97) * F.lit(0.01)).alias("latitude"),
        (77 + (F.col("c_nationkey") % 25) * F.lit(0.03)).alias("longitude"),
    )


def breakpoints(spark) -> DataFrame:
    """The 42 fixed breakpoint rows."""
    return spark.createDataFrame(breakpoint_rows(), BREAKPOINT_SCHEMA)
