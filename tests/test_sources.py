import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from hazeline.functions import clock, text
from hazeline.operators import audit as au
from hazeline.operators import cleaning as cl
from hazeline.sources import readers as rd
from hazeline.sources import sinks as sk
from hazeline.streaming import archive as st
from conftest import ts


def test_station_csv_files(spark, tmp_path):
    (tmp_path / "Raw_Data_2021_site_101_station_a_hspcb_1Hr.csv").write_text(
        'Timestamp,"PM2.5 (µg/m³)","PM10 (µg/m³)","AT (°C)",Extra\n2021-01-01 00:00:00,12.5,1000,NA,x\n2021-01-01 01:00:00,-,abc,7.5,y\n')
    (tmp_path / "Raw_Data_2021_site_102_station_b_dpcc_1Hr.csv").write_text(
        'Timestamp,"PM10 (µg/m³)","Ozone (µg/m³)"\n2021-01-01 00:00:00,5,9\n')
    got = cl.flag_capped(rd.scan_obs_csv(spark, str(tmp_path))).orderBy("station", "ts").collect()
    assert [(r["station"], str(r["ts"]), r["pm25"], r["pm10"], r["at"], r["o3"], r["pm10_capped"]) for r in got] == [
        ("station_a", "2021-01-01 00:00:00", 12.5, 1000.0, None, None, True),
        ("station_a", "2021-01-01 01:00:00", None, None, 7.5, None, False),
        ("station_b", "2021-01-01 00:00:00", None, 5.0, None, 9.0, False),
    ]


def test_headers_by_token():
    kept = {"PM2.5-avg": "pm25", "pm25": "pm25", "PM25x": "pm25", "PM10_raw": "pm10", " PM10": "pm10", "NO2/ppb": "no2", "WS:10m": "ws", "CO[mg]": "co",
            "Ozone-8h": "o3", "NH3": "nh3", "at (C)": "at", "SO2.1": "so2", "RH %": "rh", "WD,deg": "wd", "sr": "sr"}
    lost = ["S.O2", "NO2x", "NO2_raw", "COx", "O3", "WS10", "Ozone\u00e9", "avg PM10", "PM2", "Timestamp", "", "ATM", "xCO"]
    assert text.canonical_columns([*kept, *lost]) == kept


def test_headers_as_columns_follow_the_same_rule(spark):
    names = ["PM2.5-avg", "PM10_raw", "NO2/ppb", "NO2_raw", "Ozone\u00e9", "Ozone", " co (mg)", "S.O2", "PM2", "at"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.canonical_column(F.col("n")).alias("to"))
    assert {r["n"]: r["to"] for r in df.collect() if r["to"]} == text.canonical_columns(names)


def test_many_layouts_in_one_plan(spark, tmp_path):
    heads = ["PM2.5 (x)", "PM10_y", "NO2/z", "CO", "Ozone-8h", "junk", '"WS, m/s"']
    for i in range(60):
        order = heads[i % 7:] + heads[:i % 7] + [f"extra{i}"] * (i % 3)
        at = i % (len(order) + 1)
        fields = [*order[:at], "Timestamp", *order[at:]]
        values = {"PM2.5 (x)": "1.5", "PM10_y": '"2"', "NO2/z": "-", "CO": str(i), "Ozone-8h": " 5 ", "junk": "x,y" if i % 2 else "x", '"WS, m/s"': "7"}
        row = ["2024-01-01 00:00:00" if f == "Timestamp" else values.get(f, "") for f in fields]
        row = [f'"{v}"' if "," in v else v for v in row]
        (tmp_path / f"site_{i}_s{i}_epa_1Hr.csv").write_text("\ufeff" * (i % 2) + ",".join(fields) + "\n\n" + ",".join(row) + "\n" + ",".join(fields) + "\n", "utf-8")
    (tmp_path / "notes.txt").write_text("Timestamp,PM10\n")
    found = rd.scan_obs_csv(spark, str(tmp_path))
    assert "Union" not in found._jdf.queryExecution().toString()
    got = {r["station"]: tuple(r[c] for c in ("pm25", "pm10", "no2", "co", "o3", "ws", "rh")) for r in found.collect()}
    assert got == {f"s{i}": (1.5, 2.0, None, float(i), 5.0, 7.0, None) for i in range(60)}
    (tmp_path / "broken.csv").write_text("a,b\n1,2\n")
    with pytest.raises(Exception, match="no Timestamp column in .*broken.csv"):
        rd.scan_obs_csv(spark, str(tmp_path)).collect()


def test_station_files_are_one_a_name_however_many_tasks_write(spark, tmp_path):
    rows = [(f"s{i % 3}", dt.datetime(2024, 1, 1, i // 3), float(i)) for i in range(60)]
    obs = spark.createDataFrame(rows, "station string, ts timestamp_ntz, pm25 double").repartition(8)
    name = F.concat(F.lit("Raw_Data_2024_site_1_"), F.col("station"), F.lit("_hspcb_1Hr.csv"))
    sk.write_station_files(obs, str(tmp_path / "layout=0"), {"pm25": "PM2.5"}, name)
    assert len(list(tmp_path.glob("layout=0/file=*"))) == len(list(tmp_path.glob("layout=0/file=*/*.csv"))) == 3
    got = rd.scan_obs_csv(spark, str(tmp_path), named=True).select("station", "ts", "pm25").collect()
    assert sorted(tuple(r) for r in got) == sorted(rows)


def test_hour_documents(spark, tmp_path):
    def rec(stamp, value, cov, key="utc"):
        return {"value": value, "period": {"datetimeFrom": {key: stamp}}, "coverage": {"percentComplete": cov}}

    docs = {"results": [
        rec("2021-10-01T18:30:00Z", 10.0, 75.0), rec("2021-10-01T18:30:00Z", 10.0, 80.0), rec("2021-10-01T19:00:00Z", 99.0, 100.0),
        rec("2021-10-01T19:30:00Z", 5.0, 74.9), rec("2021-10-02T02:00:00+05:30", 6.0, None, "local"), rec("2021-10-01T21:30:00Z", None, 100.0),
    ]}
    (tmp_path / "station_x_pm25_20211001_20211101.json").write_text(json.dumps(docs))
    (tmp_path / "station_x_pm10_20211001_20211101.json").write_text("{ not json")
    (tmp_path / "notes.json").write_text(json.dumps(docs))
    raw = rd.scan_hour_json(spark, str(tmp_path))
    assert raw.count() == 6
    got = cl.hour_records_clean(raw, ["station", "parameter"]).orderBy("ts").collect()
    assert [(r["station"], r["parameter"], str(r["ts"]), r["value"]) for r in got] == [
        ("station_x", "pm25", "2021-10-02 00:00:00", 10.0), ("station_x", "pm25", "2021-10-02 02:00:00", 6.0)]


def test_driver_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "pm2_5": [1.0, None]}}))
    (tmp_path / "b.json").write_text(json.dumps({"hourly": {"time": []}}))
    (tmp_path / "c.json").write_text('{"hourly": {"time": ["2024-01-01T00:00"')
    got = rd.scan_driver_json(spark, str(tmp_path), ["pm2_5", "pm10"]).orderBy("ts").collect()
    assert [(r["station"], str(r["ts"]), r["pm2_5"], r["pm10"]) for r in got] == [
        ("a", "2024-01-01 00:00:00", 1.0, None), ("a", "2024-01-01 01:00:00", None, None)]


def test_documents_need_their_manifest(spark, tmp_path):
    docs = spark.createDataFrame([(ts("2024-01-01 06:00:00"), "a", [(1, 2.0), (2, None)]), (ts("2024-01-02 06:00:00"), "a", [])],
                                 "issue_time timestamp_ntz, station string, hourly array<struct<lead_h:int,p50:double>>")
    sk.write_documents(docs, str(tmp_path / "d"))
    assert sorted(map(repr, rd.scan_documents(spark, str(tmp_path / "d")).select(*docs.columns).collect())) == sorted(map(repr, docs.collect()))
    spark.createDataFrame([("{\"issue_time\": \"2024-01-03T06:00:00.000\", \"station\": \"late\"}",)], "v string").write.mode("append").text(str(tmp_path / "d" / "documents"))
    assert rd.scan_documents(spark, str(tmp_path / "d")).count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        rd.scan_documents(spark, str(tmp_path / "d" / "documents"))


def test_registry_and_breakpoint_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text('id,name,lat,lon\na,"A, B",28.5,77\n')
    assert tuple(rd.scan_stations(spark, str(tmp_path / "s.csv")).first()) == ("a", "A, B", 28.5, 77.0)
    with pytest.raises(ValueError):
        rd.scan_breakpoints(spark, str(tmp_path / "s.csv"))
    assert rd.scan_fires(spark, str(tmp_path / "none")).count() == 0


def test_location_flattening(spark):
    schema = ("id int, name string, provider struct<name:string>, owner struct<name:string>, coordinates struct<latitude:double,longitude:double>,"
              "sensors array<struct<id:string,parameter:struct<name:string>,datetimeFirst:struct<utc:string>,datetimeLast:struct<utc:string>>>")
    rows = [(1, "A", ("P",), ("O",), (1.0, 2.0), [("s", ("PM25",), ("f",), None), ("t", ("so2",), None, None)]), (2, None, ("P",), ("P",), None, None), (3, "C", None, None, None, [])]
    got = {r["id"]: r for r in rd.location_sensors(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1]["provider_owner"], got[1]["has_pm25"], got[1]["has_pm10"], len(got[1]["pm_sensors"])) == ("P / O", True, False, 1)
    assert (got[2]["provider_owner"], got[2]["name"]) == ("P", "Unknown") and got[3]["provider_owner"] == "Unknown"


def test_names_and_times(spark):
    names = {
        # an hourly file: the last word of letters before the ending is the agency, other words belong to the station
        "site_12_north_quay_epa_1Hr.csv": "north_quay", "Site_3_quay_4b_1hr.CSV": "quay_4b", "old_site_7_pier_1Hr.csv": "pier",
        "site_8_pier_two_9_1Hr.csv": "pier_two_9", "site_9_one_two_1HR.CSV": "one",
        # another file of the main agency
        "site_4_pier_east_hspcb_15Min.csv": "pier_east", "site_4_pier_HSPCB_2020_hspcb.txt": "pier",
        # anything else: the stem, less a raw-data prefix and one of the endings
        "raw_data_2020_site_55_pier.csv": "pier", "Raw_Data_20_site_5_pier.csv": "Raw_Data_20_site_5_pier", "site_5_pier.csv": "site_5_pier",
        "x_dpcc_1Hr.csv": "x", "x_dpcc.1Hr.csv": "x", "x_dpcc1Hr.csv": "x", "x_.1Hr.csv": "x", "x__1Hr.csv": "x", "x_1hr.csv": "x", "x_uppcb_1HR.csv": "x",
        "x1Hr.csv": "x1Hr", "x_epa.1Hr.csv": "x_epa.1Hr", "other.csv": "other", "two.dots.csv": "two.dots", ".csv": ".csv", "site_6__1Hr.csv": "site_6",
    }
    df = spark.createDataFrame([(n,) for n in names], "f string").withColumn("s", text.station_from_filename(F.col("f")))
    assert {r["f"]: r["s"] for r in df.collect()} == names
    r = spark.range(1).select(
        text.slugify(F.lit(" Sector-11, Norwick ")).alias("slug"),
        *[clock.utc_hhmm_to_local_hour(F.lit(v)).alias(f"h{v}") for v in (2030, 1955, 1945)],
        clock.to_local(F.lit("2021-10-01T18:30:00Z")).cast("string").alias("a"), clock.to_local(F.lit("2021-10-01 05:00:00"), naive="IST").cast("string").alias("b"),
    ).first()
    assert tuple(r) == ("sector_11_norwick", 2, 1, 1, "2021-10-02 00:00:00", "2021-10-01 05:00:00")


def test_subhourly_rule(spark):
    rows = [("q", ts(f"2024-01-01 00:{m:02d}:00"), 1.0 + m) for m in (0, 15, 30, 45)] + [("q", ts(f"2024-01-01 01:{m:02d}:00"), 5.0) for m in (0, 15)]
    rows += [("h", ts("2024-01-01 00:00:00"), 2.0), ("h", ts("2024-01-01 00:00:00"), 2.0), ("h", ts("2024-01-01 00:30:00"), 4.0)]
    df = spark.createDataFrame(rows, "s string, ts timestamp_ntz, value double")
    got = sorted((r["s"], r["ts"].hour, r["value"]) for r in cl.subhourly_to_hourly(df, ["s"]).collect())
    assert got == [("h", 0, 3.0), ("q", 0, 23.5)]


def test_duplicate_series_and_continuity(spark):
    rows = []
    for k, s in enumerate(("a", "b", "c", "d")):
        for h in range(10):
            v = None if h == 4 else float(h)
            rows.append((s, ts(f"2024-01-0{1 + (s == 'b')} {h:02d}:00:00"), v if s != "c" else (v or 0.0) + 1))
    df = spark.createDataFrame(rows, "station string, ts timestamp_ntz, pm25 double")
    assert sorted((r["station"], r["same_as"]) for r in cl.duplicate_series(df).collect()) == [("b", "a"), ("d", "a")]
    gaps = spark.createDataFrame([("a", ts("2024-01-01 00:00:00")), ("a", ts("2024-01-01 00:00:00")), ("a", ts("2024-01-01 03:00:00")), ("a", ts("2024-03-01 03:00:00"))], "station string, ts timestamp_ntz")
    assert tuple(au.continuity_audit(gaps).first()) == ("a", 1, 2)


def test_windows(spark):
    w = au.date_chunks(spark.createDataFrame([(2021,)], "year int")).orderBy("window_from").collect()
    assert len(w) == 13 and (str(w[-1]["window_from"]), w[-1]["n_days"]) == ("2021-11-30", 1)
    s = au.season_windows(spark.createDataFrame([(2023,), (2020,)], "start_year int")).collect()
    assert len(s) == 10 and {r["season"]: r["n_days"] for r in s if str(r["window_from"]).endswith("02-01")} == {"2023-2024": 29, "2020-2021": 28}


def test_archive_streams_are_idempotent(spark, tmp_path):
    land, arch, state = (str(tmp_path / n) for n in ("landing", "archive", "state"))
    schema = st.READING_SCHEMA

    def drop(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(land)

    one = ("a", ts("2024-01-01 00:00:00"), 1.0, None, None, None, "x")
    drop([one, one[:2] + (9.0,) + one[3:]])
    st.stream_observations(spark, land, arch, state)
    drop([one[:2] + (5.0,) + one[3:], ("a", ts("2024-01-01 01:00:00"), 2.0, None, None, None, "x")])
    st.stream_observations(spark, land, arch, state)
    st.stream_observations(spark, land, arch, state)
    assert sorted((r["ts"].hour, r["pm25"]) for r in spark.read.parquet(arch).collect()) == [(0, 1.0), (1, 2.0)]


def test_cycle_archive_and_hourly_sink(spark, tmp_path):
    rows = [("a", ts(f"2024-01-01 {h:02d}:00:00"), float(h)) for h in range(4)]
    d = spark.createDataFrame(rows, "station string, ts timestamp_ntz, pm2_5 double")
    met = d.select("station", "ts", F.lit(1.0).alias("temperature_2m"))
    reg = spark.createDataFrame([("a", "A", 1.0, 2.0)], "station string, name string, lat double, lon double")
    cycle = rd.archive_cycle(d, met, reg, F.lit("2024-01-01 00:40:00").cast("timestamp_ntz"))
    assert sorted((r["valid_time"].hour, r["lead_h"]) for r in cycle.collect()) == [(2, 1), (3, 2)]
    sk.write_cycle(cycle, str(tmp_path / "c"))
    assert (tmp_path / "c" / "issue_date=2024-01-01").is_dir()
    sk.write_hourly(d, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 4
