"""Known values: projection, distances, summer time, track counts, levels."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.functions import arrays, geo, timeops
from trajspark.operators import distance, tracks


def test_projection_of_receivers(spark):
    rows = [("52°27'13\"N", "9°45'37\"E"), ("52°27'60\"N", "9°47'25\"E"), ("52°28'06\"N", "9°37'09\"E")]
    x, y = geo.utm(geo.dms(F.col("a")), geo.dms(F.col("b")))
    got = spark.createDataFrame(rows, "a string, b string").select(x, y).collect()
    for g, w in zip(got, [(551663.90, 5811763.862), (553686.61, 5813237.888), (542060.92, 5813309.888)], strict=True):
        assert tuple(g) == pytest.approx(w, abs=0.01)


def test_distances_of_two_lines():
    a, b = np.array([[[0, 0], [1, 1], [2, 2]]], float), np.array([[[0, 0], [1, 2], [2, 4]]], float)
    assert distance.dtw(a, b, "symmetric1")[0] == pytest.approx(3)
    assert distance.dtw(a, b, "symmetric2")[0] == pytest.approx(5)
    assert distance.frechet(a, b)[0] == pytest.approx(2)
    assert distance.lcss(a, a, 0.5)[0] == pytest.approx(0)


@pytest.mark.parametrize(("local", "utc"), [((2022, 3, 27, 2, 30), (2022, 3, 27, 1, 0)), ((2022, 10, 30, 2, 30), (2022, 10, 30, 1, 30)), ((2022, 7, 1, 12, 0), (2022, 7, 1, 10, 0))])
def test_berlin_time(spark, local, utc):
    d = spark.createDataFrame([(dt.datetime(*local),)], "t timestamp_ntz").select(timeops.berlin_to_utc(F.col("t")).cast("timestamp_ntz"))
    assert d.first()[0] == dt.datetime(*utc)


def test_track_counts_and_levels(spark):
    n = tracks.track_counts(spark.createDataFrame([("f", 10)], "flow string, total long"), ["flow"], "total").collect()
    assert sorted((int(r["n_flights"]) if "n_flights" in r else int(r[-1])) for r in n)[-1] == 4
    level = spark.range(1).select(arrays.to_db(arrays.to_energy(F.lit(50.0)) * 2)).first()[0]
    assert level == pytest.approx(53.0103, abs=1e-4)
