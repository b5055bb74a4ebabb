import math

import pytest
from pyspark.sql import functions as F

from hazeline.constants import breakpoint_rows
from hazeline.functions import index as ix
from hazeline.functions.numeric import erfc, nan_to_null, round_half_even
from hazeline.operators import daily as dy
from conftest import ts


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("pm25,pm10,index,name", [
    (30, 50, 50, "Good"), (60, 100, 100, "Satisfactory"), (90, 250, 200, "Moderate"), (120, 350, 300, "Poor"),
    (250, 430, 400, "Very Poor"), (380, 500, 500, "Severe"), (380, 400, 452, "Severe"),
])
def test_joint_index(spark, pm25, pm10, index, name):
    got = ix.pm_to_aqi(spark.createDataFrame([(float(pm25), float(pm10))], "pm25 double, pm10 double")).first()
    assert (got["aqi"], got["category"]) == (index, name)


def test_every_band_edge_and_midpoint(spark):
    rows = [(p, c, lo + (hi - lo) * (c - a) / (b - a)) for p, _, a, b, lo, hi, _ in breakpoint_rows() for c in (a, b, (a + b) / 2)]
    df = spark.createDataFrame(rows, "p string, c double, want double")
    got = df.withColumn("got", ix.sub_index_any("p", "c")).collect()
    assert len(got) == 126
    for r in got:
        assert abs(r["got"] - r["want"]) <= 0.5


def test_gap_modes(spark):
    assert one(spark, ix.sub_index("PM2.5", "30.5D")) == 313
    assert one(spark, ix.sub_index("PM2.5", "30.5D", "continuous")) == 50
    assert one(spark, ix.sub_index("PM10", "50.5D")) == -145
    assert one(spark, ix.aqi_category("200.5D")) == "Good"
    assert one(spark, ix.aqi_category("200.5D", "continuous")) == "Moderate"
    assert one(spark, ix.sub_index(" pm 2.5 ", "251.0D")) == 401
    assert one(spark, ix.sub_index("lead", "1.0D")) is None
    assert one(spark, ix.sub_index("PM10", "-1.0D")) is None
    assert one(spark, ix.aqi_category("CAST(NULL AS DOUBLE)")) == "Unknown"
    assert one(spark, ix.aqi_category("900.0D")) == "Severe"


def test_dominant_and_max(spark):
    df = spark.createDataFrame([(40.0, 300.0), (None, None)], "pm25 double, pm10 double")
    assert {r["pm25"]: r["dominant"] for r in ix.dominant_pollutant(df, ["pm25", "pm10"]).collect()} == {40.0: "pm10", None: None}


def test_reporting_day_edges_and_valid_hours(spark):
    rows = [("a", ts("2024-01-01 17:00:00"), 1.0), ("a", ts("2024-01-02 16:00:00"), 3.0), ("a", ts("2024-01-02 16:00:01"), 9.0)]
    df = spark.createDataFrame(rows, "station string, ts timestamp_ntz, pm25 double")
    got = {str(r["date"]): r["pm25"] for r in dy.daily_average(df, ["pm25"], 2).collect()}
    assert got == {"2024-01-02": 2.0, "2024-01-03": None}


def test_p_severe_samples(spark):
    rows = [("a", 300.0, 10.0), ("a", 10.0, None), ("a", None, None), ("b", None, None)]
    df = spark.createDataFrame(rows, "g string, pm25 double, pm10 double")
    got = {r["g"]: (r["p_severe"], r["n_valid"]) for r in dy.p_severe_samples(df, ["g"]).collect()}
    assert got == {"a": (0.5, 2), "b": (0.0, 0)}


def test_erfc_against_libm(spark):
    xs = [i / 40 - 6 for i in range(481)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert max(abs(r["e"] - math.erfc(r["x"])) for r in df.select("x", erfc(F.col("x")).alias("e")).collect()) < 1e-12


def test_missing_and_rounding(spark):
    assert one(spark, nan_to_null(F.lit(float("nan")))) is None
    assert one(spark, nan_to_null(F.lit(float("-inf")))) is None
    assert [one(spark, round_half_even(F.lit(v))) for v in (0.5, 1.5, 2.5)] == [0.0, 2.0, 2.0]
