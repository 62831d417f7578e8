"""Readers and writers on small files."""

from __future__ import annotations

import datetime as dt
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.sources import readers, writers


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_of_drifting_columns(spark, tmp_path):
    write(tmp_path / "b.csv", "t_ref,x,extra\n2022-01-02 10:00:00,3,u\n")
    write(tmp_path / "a.csv", "x,t_ref,when\n1,2022-01-01 09:00:00,2022-03-04 05:06:07\n2,,\n")
    d = readers.csv(spark, f"{tmp_path}/*.csv", parse_dates=["t_ref", "when", "nowhere"])
    rows = {r["x"]: r for r in d.collect()}
    assert rows[1]["t_ref"] == dt.datetime(2022, 1, 1, 9) and rows[1]["when"] == dt.datetime(2022, 3, 4, 5, 6, 7) and rows[2]["t_ref"] is None
    assert rows[3]["extra"] == "u" and rows[3]["when"] is None and rows[1]["_file"] == "a.csv"
    assert [r["x"] for r in readers.csv(spark, f"{tmp_path}/*.csv", first=2).collect()] == [1, 2]
    with pytest.raises(FileNotFoundError):
        readers.csv(spark, f"{tmp_path}/*.none")


def test_separator_is_sniffed(spark, tmp_path):
    p = write(tmp_path / "m.csv", "x;y;z;cumulative_res\n1;2;3;50.5\n")
    assert readers.sniff(spark, p) == ";"
    assert readers.csv_auto(spark, p).collect()[0].asDict() == {"x": 1, "y": 2, "z": 3, "cumulative_res": 50.5}
    m = readers.noise_map(spark, p).collect()[0]
    assert (m["x"], m["cumulative_res"], m["_file"]) == (1.0, 50.5, "m.csv")


def test_batches_are_cleaned_and_ordered(spark, tmp_path):
    rows = [("2022-01-01 00:00:02", 1.0, 2.0, " dlh1 "), ("2022-01-01 00:00:01", 1.0, 2.0, "nan"), (None, 1.0, 2.0, "A"), ("2022-01-01 00:00:00", None, 2.0, "B"), ("2022-01-01 00:00:03", 1.0, 2.0, "")]
    spark.createDataFrame(rows, "timestamp string, latitude double, longitude double, callsign string").coalesce(1).write.parquet(f"{tmp_path}/d")
    write(tmp_path / "d" / "broken.parquet", "no parquet")
    got = [(r["timestamp"].second, r["callsign"]) for r in readers.batches(spark, f"{tmp_path}/d").collect()]
    assert got == [(1, None), (2, "DLH1"), (3, None)]


def test_latest_and_months(spark, tmp_path):
    for name, v in (("preprocessed_2", 2), ("preprocessed_10", 10), ("adsb_2022-04", 4), ("adsb_2022-12", 12)):
        spark.createDataFrame([(v,)], "v int").write.parquet(f"{tmp_path}/{name}.parquet")
    assert readers.latest(spark, str(tmp_path)).endswith("preprocessed_2.parquet")  # by name, not by number
    assert sorted(r["v"] for r in readers.months(spark, str(tmp_path), ["2022-04", "2022-12"]).collect()) == [4, 12]
    with pytest.raises(FileNotFoundError):
        readers.months(spark, str(tmp_path), ["2022-05"])
    with pytest.raises(FileNotFoundError):
        readers.latest(spark, str(tmp_path), "none_*")


def test_chosen_columns_and_rows_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 as k", "'x' as wide").write.parquet(f"{tmp_path}/t")
    d = readers.chosen(spark.read.parquet(f"{tmp_path}/t"), ["id"], "k", [1, 2])
    assert d.count() == 29 and "wide" not in d._jdf.queryExecution().executedPlan().toString()
    some = spark.createDataFrame([(3,), (3,), (None,)], "v long")
    assert readers.chosen(spark.read.parquet(f"{tmp_path}/t"), ["id", "k"], "k", some).count() == 14
    with pytest.raises(ValueError, match="nope"):
        readers.chosen(d, ["nope"])


def test_columns_by_synonym_and_contract(spark):
    d = spark.createDataFrame([(1, "a")], "`Trajectory ID` int, other string")
    r = readers.resolve(d, {"track": ("trajectory_id",), "other": ("x",)})
    assert r.columns == ["track", "other"]
    c = readers.contract(r, {"missing": "double", "track": "string"}).collect()[0]
    assert c.asDict() == {"missing": None, "track": "1", "other": "a"}
    with pytest.raises(ValueError, match="nope"):
        readers.require(r, ["track", "nope"])


def test_tracks_of_three_kinds(spark, tmp_path):
    np.savez(tmp_path / "t.npz", one=np.array([[0.0, 1.0], [2.0, 3.0]]), two=np.array([[4.0, 5.0, 6.0]]))
    z = sorted((r["track"], r["idx"], r["x"], r["y"], r["z"]) for r in readers.tracks(spark, f"{tmp_path}/t.npz").collect())
    assert z == [("one", 0, 0.0, 1.0, 0.0), ("one", 1, 2.0, 3.0, 0.0), ("two", 0, 4.0, 5.0, 6.0)]
    p = write(tmp_path / "t.csv", "Flight_ID;Longitude;Latitude;time\n7;1.5;2.5;0\n")
    assert readers.tracks(spark, p).collect()[0].asDict() == {"track": 7, "x": 1.5, "y": 2.5, "t": 0}
    spark.createDataFrame([(1, 2.0)], "id int, x double").write.parquet(f"{tmp_path}/bad.parquet")
    with pytest.raises(ValueError, match="y"):
        readers.tracks(spark, f"{tmp_path}/bad.parquet")
    with pytest.raises(ValueError, match="pickled"):
        readers.tracks(spark, "x.joblib")


def test_weather_tables_are_joined_by_time(spark, tmp_path):
    wind = write(tmp_path / "w.csv", "STATIONS_ID;MESS_DATUM; FF_10;DD_10\n1;202201010000;3.5;180\n1;202101010000;1;90\n")
    rest = write(tmp_path / "r.csv", "STATIONS_ID;MESS_DATUM;PP_10\n1;202201010000;1013\n1;202201010010;1012\n")
    got = readers.weather(spark, wind, rest, 2022).collect()
    assert len(got) == 1 and (got[0]["FF_10"], got[0]["PP_10"]) == ("3.5", "1013")


def test_writers_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, [1.0, 2.0], {"a": 1}), (2, None, None)], "id int, v array<double>, m map<string,int>")
    writers.parquet_and_csv(d, f"{tmp_path}/p", f"{tmp_path}/c")
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/p").collect()) == [1, 2]
    c = {r["id"]: r for r in spark.read.option("header", True).csv(f"{tmp_path}/c").collect()}
    assert json.loads(c["1"]["v"]) == [1.0, 2.0] and json.loads(c["1"]["m"]) == {"a": 1} and c["2"]["v"] is None
    for kind in ("parquet", "csv"):
        for _ in range(2):
            writers.append(d, f"{tmp_path}/a_{kind}", kind)
    assert spark.read.parquet(f"{tmp_path}/a_parquet").count() == 4 and spark.read.option("header", True).csv(f"{tmp_path}/a_csv").count() == 4


def test_transposed_kml_markdown_and_ground_tracks(spark, tmp_path):
    t = writers.transposed(spark.createDataFrame([("A", 1, "x"), ("B", 2, "y")], "name string, n int, s string"), "name", ["n", "s"]).collect()
    assert [r.asDict() for r in t] == [{"attribute": "n", "A": "1", "B": "2"}, {"attribute": "s", "A": "x", "B": "y"}]
    d = spark.createDataFrame([("a<b&c", [9.5, 9.6], [52.0, 52.1], [100.0, 90.0])], "n string, lon array<double>, lat array<double>, alt array<double>")
    mark = d.select(writers.placemark(F.col("n"), F.col("lon"), F.col("lat"), F.col("alt"), F.lit("s1"))).first()[0]
    assert "<name>a&lt;b&amp;c</name>" in mark and "9.5,52.0,100.0 9.6,52.1,90.0" in mark
    import xml.etree.ElementTree as ET

    assert ET.fromstring(writers.kml([mark], {"s1": "ff0000ff"}).encode()).tag.endswith("kml")
    assert writers.markdown(spark.createDataFrame([(1, None)], "a int, b string")).splitlines() == ["| a | b |", "|---|---|", "| 1 |  |"]
    with pytest.raises(ValueError, match="rows"):
        writers.markdown(spark.range(5).toDF("a"), most=3)
    writers.ground_tracks(spark.createDataFrame([(0, 1.5)], "step int, x double"), f"{tmp_path}/g")
    lines = [x for f in os.listdir(f"{tmp_path}/g") if f.endswith(".csv") for x in open(f"{tmp_path}/g/{f}").read().splitlines()]
    assert set(lines) == {"step;x", "0;1.5"} and lines.count("0;1.5") == 1
    assert writers.cache_path("r", a=1, b=[2]) == writers.cache_path("r", b=[2], a=1) != writers.cache_path("r", a=2, b=[2])
