"""Experiments end to end: labels, counts, scores, samples, precomputed distances, failures; preprocessing and joins by hand."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.functions import geo, timeops
from trajspark.operators import flights, joins, resample, segment
from trajspark.plans import preprocess, runner
from trajspark.streaming import windows


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    rows = []
    for flow, runway in (("A_27", "27"), ("D_09", "09")):
        for i in range(24):
            line = np.column_stack([np.linspace(0, 10, 6), np.full(6, 5.0 * (i % 2))]) + rng.normal(0, 0.1, (6, 2))
            rows.append((flow, runway, 100 * (flow == "D_09") + i, line.ravel().tolist()))
    return spark.createDataFrame(rows, "flow string, runway string, id long, v array<double>").cache()


def test_labels_counts_scores_and_settings(spark, vectors, tmp_path):
    runner.cluster_experiment(vectors, ["flow"], "id", "v", {"method": "agglomerative", "params": {"n_clusters": 2}, "count_by": ["runway"]}, f"{tmp_path}/e", vectors)
    lab = {r["id"]: r["cluster_id"] for r in spark.read.parquet(f"{tmp_path}/e/labels").collect()}
    assert [lab[i] for i in range(24)] == [i % 2 for i in range(24)]
    counts = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/e/cluster_counts").select("flow", "cluster_id", "n_flights", "is_noise_cluster").collect()))
    assert counts == [("A_27", 0, 12, False), ("A_27", 1, 12, False), ("D_09", 0, 12, False), ("D_09", 1, 12, False)]
    by = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/e/counts_by_runway").select("flow", "cluster_id", "runway", "n_flights").collect()))
    assert by[0] == ("A_27", 0, "27", 12) and len(by) == 4
    m = {r["flow"]: r for r in spark.read.parquet(f"{tmp_path}/e/metrics").collect()}
    assert m["A_27"]["silhouette"] > 0.8 and m["A_27"]["noise_frac"] == 0 and m["A_27"]["mode"] == "all" and m["A_27"]["n_total"] == 24
    assert spark.read.parquet(f"{tmp_path}/e/metrics_global").first()["silhouette"] == pytest.approx((m["A_27"]["silhouette"] + m["D_09"]["silhouette"]) / 2)
    assert "method: agglomerative" in "\n".join(r[0] for r in spark.read.text(f"{tmp_path}/e/config_resolved").collect())
    assert runner.is_done(f"{tmp_path}/e") and not runner.is_done(f"{tmp_path}/none")


@pytest.mark.parametrize(
    ("method", "params", "more"),
    [
        ("agglomerative", {"n_clusters": 2}, {"metric": "dtw"}),
        ("agglomerative", {"n_clusters": 2}, {"metric": "frechet"}),
        ("agglomerative", {"n_clusters": 2}, {"metric": "lcss", "metric_params": {"epsilon": 1.0, "alpha": 0.3}}),
        ("hdbscan", {"min_cluster_size": 5, "min_samples": 3}, {"metric": "dtw", "candidate_k": 6}),
        ("dbscan", {"eps": 3.0, "min_samples": 3}, {"metric": "dtw", "candidate_k": 8}),
        ("optics", {"min_samples": 4, "xi": 0.2, "min_cluster_size": 0.3}, {"metric": "dtw", "candidate_k": 8}),
    ],
)
def test_precomputed_distances_end_to_end(spark, vectors, tmp_path, method, params, more):
    runner.cluster_experiment(vectors, ["flow"], "id", "v", {"method": method, "params": params, "cache": f"{tmp_path}/cache", **more}, f"{tmp_path}/e")
    lab = {r["id"]: r["cluster_id"] for r in spark.read.parquet(f"{tmp_path}/e/labels").collect()}
    groups = [{lab[i] for i in range(k, 24, 2)} - {-1} for k in (0, 1)]
    # Inside a component of one cluster HDBSCAN may find noise only, but clusters never mix.
    assert len(lab) == 48 and not groups[0] & groups[1] and (method == "hdbscan" or all(len(g) == 1 for g in groups))
    m = {r["flow"]: r for r in spark.read.parquet(f"{tmp_path}/e/metrics").collect()}
    few = m["A_27"]["n_clusters"] < 2  # of which there are no scores either, and that reason comes first
    assert (m["A_27"]["reason"] == ("<2 clusters" if few else "sparse")) if "candidate_k" in more else (m["A_27"]["silhouette"] > 0.5)
    assert method == "hdbscan" or not few
    tables = list((tmp_path / "cache").iterdir())
    assert len(tables) == 1
    again = runner.recomputed(spark, f"{tmp_path}/e", spark.read.parquet(str(tables[0])), ["flow"], "id").collect()
    assert {r["flow"]: r["silhouette"] for r in again} == {f: r["silhouette"] for f, r in m.items()}


def test_a_sample_is_labelled_and_said(spark, vectors, tmp_path):
    runner.cluster_experiment(vectors, ["flow"], "id", "v", {"method": "kmeans", "params": {"n_clusters": 2}, "sample": 9}, f"{tmp_path}/e")
    assert spark.read.parquet(f"{tmp_path}/e/labels").count() == 18
    m = spark.read.parquet(f"{tmp_path}/e/metrics").first()
    assert (m["mode"], m["n_units"], m["n_total"]) == ("sample_only", 9, 24)


def test_a_failing_flow_leaves_no_scores(spark, vectors, tmp_path):
    bad = vectors.withColumn("v", F.when(F.col("id") == 105, F.array(F.lit(1.0))).otherwise(F.col("v")))
    status = runner.run_grid({"method": "kmeans", "params": {}}, [{"name": "X", "params": {"n_clusters": [2]}}], str(tmp_path), lambda name, c, folder: runner.cluster_experiment(bad, ["flow"], "id", "v", c, folder))
    assert status["X"].startswith("failed") and not (tmp_path / "X" / "metrics").exists() and not runner.is_done(f"{tmp_path}/X")


def test_grids_are_expanded_skipped_and_promoted(spark, vectors, tmp_path):
    grid = [{"name": "G", "params": {"n_clusters": [2, 3]}}, {"method": "dbscan", "params": {"eps": 1.0}}]
    base = {"method": "kmeans", "params": {}, "seed": 3}
    found = dict(runner.experiments(base, grid))
    assert list(found) == ["G_01", "G_02", "EXP002"] and found["G_02"]["params"] == {"n_clusters": 3} and found["EXP002"]["method"] == "dbscan" and found["EXP002"]["seed"] == 3
    run = lambda name, c, folder: runner.cluster_experiment(vectors, ["flow"], "id", "v", c, folder)
    assert runner.run_grid(base, grid, str(tmp_path), run, ids={1}) == {"G_01": "done"}
    assert runner.run_grid(base, grid, str(tmp_path), run, ids={1}) == {"G_01": "skipped"}
    assert runner.only("1,3-5") == {1, 3, 4, 5} and runner.only("") is None and runner.next_id(["exp_7", "exp_12", "x"], "exp") == 13
    assert [g["promoted"] for g in runner.promote([{"name": "a"}, {"name": "b"}], {"m": "b"})] == [False, True]
    (tmp_path / "c.yaml").write_text("a: {b: 1, c: 2}\n")
    assert runner.merge(runner.load(f"{tmp_path}/c.yaml"), {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_overall_means_are_weighted(spark):
    m = spark.createDataFrame([("a", 1.0, 2.0, 1), ("b", 3.0, None, 3)], "flow string, s double, d double, n_units long")
    assert runner.overall(m, ["s", "d"]).first().asDict() == {"s": 2.5, "d": 2.0, "n_units": 4}
    assert runner.overall(m, ["s", "d"], complete=True).first().asDict() == {"s": 1.0, "d": 2.0, "n_units": 1}
    moved = runner.relocated(spark.createDataFrame([("/old/x/a.csv",), ("/older/b",)], "p string"), "p", "/old/", "/new")
    assert sorted(r["p"] for r in moved.collect()) == ["/new/x/a.csv", "/older/b"]


def points(spark, n=2, steps=30):
    rng = random.Random(3)
    rows = []
    for f in range(n):
        for i in range(steps):
            rows.append(("A", "27L" if f else " 27R ", f"id{f}", dt.datetime(2022, 1, 1, f) + dt.timedelta(seconds=4 * i), 1_000 * f + i, 10.0 * i + rng.random(), 5.0 * i, 5_000.0 - 100 * i, f"T{f}" if i == 0 else "other"))
    return spark.createDataFrame(rows, "flow string, runway string, icao24 string, ts timestamp_ntz, n long, x double, y double, dist double, type string").repartition(3)


def test_preprocessing_by_hand(spark):
    s = preprocess.Settings(n_points=7, width=5, degree=2, runways=["27L", "27R"], max_distance=4_950.0, min_length=50.0)
    got = preprocess.preprocess(points(spark), ["flow"], ["icao24"], "ts", "n", ("x", "y"), "dist", runway="runway", s=s, meta=["icao24", "type", "runway"]).collect()
    raw = sorted(points(spark).collect(), key=lambda r: r["n"])
    v = np.vander(np.arange(5) - 2.0, 3, increasing=True)
    hat = v @ np.linalg.pinv(v)
    for f in (0, 1):
        rows = [r for r in raw if r["icao24"] == f"id{f}" and r["dist"] <= 4_950]
        x = np.array([r["x"] for r in rows])
        smooth = np.array([hat[min(i, 2) if i < 2 else 4 - min(len(x) - 1 - i, 2)] @ x[min(max(i - 2, 0), len(x) - 5) :][:5] for i in range(len(x))])
        t = np.array([(r["ts"] - rows[0]["ts"]).total_seconds() for r in rows])
        grid = np.linspace(0, t[-1], 7)
        mine = sorted((r for r in got if r["icao24"] == f"id{f}"), key=lambda r: r["step"])
        assert [r["step"] for r in mine] == list(range(7)) and {r["type"] for r in mine} == {"other"}  # the first row is beyond the distance
        assert [r["x"] for r in mine] == pytest.approx(np.interp(grid, t, smooth)) and [r["dist"] for r in mine] == pytest.approx(np.interp(grid, t, [r["dist"] for r in rows]))
    raw_mode = preprocess.preprocess(points(spark), ["flow"], ["icao24"], "ts", "n", ("x", "y"), "dist", s=preprocess.Settings(n_points=None, smooth=None), meta=["type"])
    assert raw_mode.count() == 60 and {r["type"] for r in raw_mode.select("type").distinct().collect()} == {"T0", "T1"}


def test_older_preparation(spark):
    d = points(spark, 1, 12).unionByName(points(spark, 1, 2).withColumn("icao24", F.lit("short")))
    got = {r["icao24"]: r for r in preprocess.legacy(d, ["icao24"], "ts", "n", ["x", "y"]).collect()}
    assert len(got["id0"]["raw_points"]) == 12 and len(got["id0"]["processed_points"]) == 20 and got["short"]["processed_points"] == []
    y = [p["y"] for p in got["id0"]["processed_points"]]
    assert (np.diff(y) > 0).all()


def test_nearest_in_time_with_fallback_keys(spark):
    at = lambda s: dt.datetime(2022, 1, 1) + dt.timedelta(seconds=s)
    left = spark.createDataFrame([(1, at(10), "A", "27"), (2, at(10), "A", "09"), (3, at(10), "D", "27"), (4, at(500), "A", "27")], "id int, ts timestamp_ntz, ad string, runway string")
    right = spark.createDataFrame([(at(8), "A", "27", "p"), (at(12), "A", "27", "q"), (at(9), "A", "33", "r")], "t timestamp_ntz, ad string, runway string, name string")
    got = {r["id"]: (r["name"], r["by"], r["time_delta_s"]) for r in joins.asof_with_fallback(left, right, "id", "ts", "t", ["ad", "runway"], ["ad"], ["name"], 30).collect()}
    assert got == {1: ("p", "keys", -2.0), 2: ("r", "fallback", -1.0), 3: (None, None, None), 4: (None, None, None)}


def test_filters_of_whole_flights(spark):
    d = spark.createDataFrame([(1, 1, True, None), (1, 2, False, 5.0), (2, 1, None, 9.0), (2, 2, True, 1.0), (3, 1, False, None)], "id int, n int, m boolean, alt double")
    ids = lambda x: sorted({r["id"] for r in x.collect()})
    assert [ids(flights.match_filter(d, "id", ["n"], F.col("m"), w)) for w in ("all", "matched", "unmatched")] == [[1, 2, 3], [1], [2, 3]]
    assert {r["id"]: (r["direction"], r["runway_time"]) for r in flights.direction(d, ["id"], "n", "alt").collect()} == {1: ("D", 1), 2: ("A", 2), 3: ("D", 1)}
    assert flights.drop_empty(d, ["m", "alt"]).count() == 2 and flights.drop_empty(spark.createDataFrame([(None, None), (1, None)], "a int, b int")).count() == 1
    with pytest.raises(ValueError, match="mode"):
        flights.drop_endpoint_outliers(d, ["m"], "id", ["n"], ("n", "alt"), "nope")


def test_small_joins_and_samples(spark):
    p = spark.createDataFrame([("f", i, j) for i in range(6) for j in range(i + 1, 6)], "flow string, id_a int, id_b int")
    one, two = (sorted(map(tuple, joins.sampled_pairs(p.repartition(k), ["flow"], "id", 4, seed=2).collect())) for k in (1, 5))
    assert one == two and len(one) == 4
    assert joins.common_key(p.withColumn("measuring_point", F.lit(1)), p) == ["x", "y", "z"]
    assert joins.common_key(*[p.withColumn("measuring_point", F.lit(1))] * 2) == ["measuring_point"]
    d = spark.createDataFrame([("a", 0, 1.0), ("a", 0, 3.0), ("a", 1, 5.0), ("a", 2, None), ("b", 0, 1.0), ("b", 1, float("nan"))], "k string, t int, x double")
    assert sorted(map(tuple, resample.average_duplicates(d, ["k"], "t", ["x"]).collect())) == [("a", 0, 2.0), ("a", 1, 5.0)]
    s = spark.createDataFrame([(f, i) for f in "ab" for i in range(9) for _ in range(2)], "f string, i int")
    assert segment.sample_ranked(s, ["f"], "i", 3).groupBy("f").count().collect()[0]["count"] == 6


def test_time_formats_and_places(spark):
    texts = ["2022-01-02 03:04:05", "02.01.2022 03:04:05", "02.01.2022 03:04", "202201020304", "nonsense", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(timeops.parse(F.col("t")).cast("timestamp_ntz")).collect()]
    assert got[:2] == [dt.datetime(2022, 1, 2, 3, 4, 5)] * 2 and got[2:4] == [dt.datetime(2022, 1, 2, 3, 4)] * 2 and got[4:] == [None, None]
    x, y = geo.utm(F.lit(52.460214), F.lit(9.683522))
    p = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert (p["x"], p["y"]) == pytest.approx((546441.178, 5812446.178), abs=0.2)


def test_streams_give_what_tables_give(spark, tmp_path):
    at = lambda s: dt.datetime(2022, 1, 1) + dt.timedelta(seconds=s)
    rows = [("u", at(s)) for s in (0, 10, 20, 100, 110)] + [("v", at(5)), ("end", at(100_000))]
    d = spark.createDataFrame(rows, "k string, ts timestamp")
    d.coalesce(1).write.parquet(f"{tmp_path}/in")
    count = [F.count(F.lit(1)).alias("n")]
    want = sorted((r["k"], r["start"], r["n"]) for r in windows.sessions(d, ["k"], "ts", "30 seconds", "1 second", count).collect() if r["k"] != "end")
    stream = spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in")
    q = windows.sessions(stream, ["k"], "ts", "30 seconds", "1 second", count).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["k"], r["start"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == want and len(want) == 3
