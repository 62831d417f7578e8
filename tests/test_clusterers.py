"""Clusterers on small groups with known clusters, with ties and duplicates; criteria; distances in tiles; ordered work in slices."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trajspark.operators import cluster, distance, evaluate, features, matrix, ranks, resample, segment, signal, tiles
from trajspark.operators import tracks as side


def blobs(seed=1, n=20, duplicates=True):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, 0.1, (n, 3)) + c for c in ([0, 0, 0], [5, 0, 0], [0, 6, 1])])
    return np.concatenate([x, x[:3], x[:3]]) if duplicates else x


def same_groups(lab, want):
    return {frozenset(np.flatnonzero(lab == k)) for k in set(lab.tolist()) if k >= 0} == {frozenset(np.flatnonzero(want == k)) for k in set(want.tolist())}


TRUTH = np.concatenate([np.repeat([0, 1, 2], 20), np.zeros(6, int)])


@pytest.mark.parametrize(
    ("name", "params"),
    [
        ("kmeans", {"n_clusters": 3, "seed": 1}),
        ("minibatch_kmeans", {"n_clusters": 3, "seed": 5}),
        ("dbscan", {"eps": 1.0, "min_samples": 4}),
        ("optics", {"min_samples": 5, "xi": 0.1, "min_cluster_size": 0.2}),
        ("hdbscan", {"min_cluster_size": 8, "min_samples": 3}),
        ("agglomerative", {"n_clusters": 3, "linkage": "average"}),
        ("agglomerative", {"n_clusters": 3, "linkage": "single"}),
        ("agglomerative", {"n_clusters": 3, "linkage": "complete"}),
        ("agglomerative", {"n_clusters": 3, "linkage": "ward"}),
        ("birch", {"n_clusters": 3, "threshold": 0.6}),
        ("spectral", {"n_clusters": 3}),
        ("gmm", {"n_components": 3, "seed": 1}),
        ("meanshift", {"bandwidth": 2.0}),
        ("affinity_propagation", {"preference": -50.0}),
        ("two_stage", {"first": "kmeans", "second": "dbscan", "first_params": {"n_clusters": 1}, "second_params": {"eps": 1.0, "min_samples": 3}}),
    ],
)
def test_known_clusters_are_found(name, params):
    lab = cluster.clusterer(name, **params)(blobs(), False)
    assert same_groups(lab[lab >= 0], TRUTH[lab >= 0]) and (lab >= 0).mean() > 0.9
    assert cluster.by_first(lab).tolist() == lab.tolist()


@pytest.mark.parametrize("name", ["dbscan", "optics", "hdbscan", "agglomerative", "spectral", "kmeans"])
def test_precomputed_distances_give_the_same_groups(name):
    params = {"dbscan": {"eps": 1.0, "min_samples": 4}, "optics": {"min_samples": 5, "xi": 0.1, "min_cluster_size": 0.2}, "hdbscan": {"min_cluster_size": 8}, "agglomerative": {"n_clusters": 3}, "spectral": {"n_clusters": 3}, "kmeans": {"n_clusters": 3, "seed": 1}}[name]
    lab = cluster.clusterer(name, **params)(cluster.distances(blobs()), True)
    assert same_groups(lab[lab >= 0], TRUTH[lab >= 0]) and (lab >= 0).mean() > 0.9


@pytest.mark.parametrize(
    ("name", "params"),
    [
        ("kmeans", {"n_clusters": 3}),
        ("minibatch_kmeans", {"n_clusters": 3}),
        ("dbscan", {"eps": 0.5, "min_samples": 4}),
        ("optics", {"min_samples": 4, "xi": 0.02}),
        ("hdbscan", {"min_cluster_size": 4, "min_samples": 3}),
        ("agglomerative", {"n_clusters": 7, "linkage": "average"}),
        ("agglomerative", {"n_clusters": 7, "linkage": "single"}),
        ("agglomerative", {"n_clusters": 7, "linkage": "complete"}),
        ("agglomerative", {"n_clusters": 7, "linkage": "ward"}),
        ("birch", {"n_clusters": 3, "threshold": 0.3}),
        ("spectral", {"n_clusters": 3}),
        ("gmm", {"n_components": 2}),
        ("meanshift", {}),
        ("affinity_propagation", {}),
        ("two_stage", {"first": "kmeans", "second": "hdbscan", "first_params": {"n_clusters": 2}, "second_params": {"min_cluster_size": 3, "min_samples": 2}}),
    ],
)
def test_flows_beyond_a_whole_matrix(monkeypatch, name, params):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.4, (70, 6)) + k for k in (0, 1.5, 3)])
    frame = pd.DataFrame({"flow": 1, "id": range(len(x)), "v": x.tolist()})
    run = lambda: cluster.flow_labels((1,), frame, ["flow"], "id", "v", name, **params)["cluster_id"].tolist()
    monkeypatch.setattr(cluster, "distances", lambda x: cluster.Rows(x)[:])
    held = run()
    monkeypatch.setattr(cluster, "MOST_UNITS", 20)
    monkeypatch.setattr(cluster, "_CELLS", 2_000)
    assert run() == held


def test_components_beyond_a_whole_matrix(spark, monkeypatch):
    x = blobs(n=30, duplicates=False)
    e = [(0, i, j, float(np.linalg.norm(x[i] - x[j]))) for i, j in itertools.combinations(range(len(x)), 2)]
    e = [r for r in e if r[3] < 0.35 or r[2] == r[1] + 1]
    d = np.full((len(x), len(x)), 2 * max(r[3] for r in e) + 1)
    for _, i, j, v in e:
        d[i, j] = d[j, i] = v
    np.fill_diagonal(d, 0)
    want = cluster.by_first(cluster.hdbscan(d, min_cluster_size=4, min_samples=3))
    edges = spark.createDataFrame(e, "flow int, id_a long, id_b long, d double")
    units = spark.createDataFrame([(0, i) for i in range(len(x))], "flow int, id long")
    monkeypatch.setattr(cluster, "MOST_UNITS", 20)
    i, j, v = (np.array([r[k] for r in e]) for k in (1, 2, 3))
    assert cluster.by_first(cluster.hdbscan(cluster.SparseRows(len(x), i, j, v, d.max()), min_cluster_size=4, min_samples=3)).tolist() == want.tolist()
    got = matrix.cluster_components(units, edges, ["flow"], "id", min_cluster_size=4, min_samples=3).orderBy("id").collect()
    assert [r["cluster_id"] for r in got] == want.tolist()


def test_information_criteria_by_hand():
    x = blobs(duplicates=False)
    details: dict = {}
    lab = cluster.gmm(x, 3, seed=1, details=details)
    n, p = x.shape
    total = 0.0
    parts = [(np.mean(lab == k), x[lab == k].mean(0), np.cov(x[lab == k].T, bias=True) + 1e-6 * np.eye(p)) for k in range(3)]
    for row in x:
        total += np.log(sum(w * np.exp(-0.5 * (row - m) @ np.linalg.solve(c, row - m)) / np.sqrt((2 * np.pi) ** p * np.linalg.det(c)) for w, m, c in parts))
    free = 3 * (p + p * (p + 1) / 2) + 2
    assert details["bic"] == pytest.approx(free * np.log(n) - 2 * total, rel=1e-6) and details["aic"] == pytest.approx(2 * free - 2 * total, rel=1e-6)
    worse: dict = {}
    cluster.gmm(x, 1, details=worse)
    assert details["bic"] < worse["bic"]


def test_hdbscan_diagnostics():
    details: dict = {}
    d = cluster.distances(blobs())
    lab = cluster.hdbscan(d, 8, 3, details=details)
    assert len(details["mst"]) == len(d) - 1 and len(details["persistence"]) == len(set(lab.tolist()) - {-1})
    assert ((details["probability"] > 0) == (lab >= 0)).all() and details["probability"].max() <= 1


def test_audit_clusterer_falls_back():
    one = np.random.default_rng(0).normal(size=(12, 2))
    assert set(cluster.audit("hdbscan", n_clusters=2, min_cluster_size=10)(one).tolist()) == {0, 1}
    assert same_groups(cluster.audit("kmeans", n_clusters=3)(blobs()), TRUTH)
    with pytest.raises(ValueError, match="none of"):
        cluster.audit("dbscan")


def test_unknown_names_and_nesting_are_refused():
    with pytest.raises(ValueError, match="unknown"):
        cluster.clusterer("nope")
    with pytest.raises(ValueError, match="nested"):
        cluster.clusterer("two_stage", first="two_stage", second="kmeans")
    with pytest.raises(ValueError, match="unknown metric"):
        distance.metric("nope")


@pytest.fixture(scope="module")
def units(spark):
    x = blobs()
    rows = [(g, 100 * g + i, v.tolist()) for g in (0, 1) for i, v in enumerate(x)] + [(None, 1_000, [0.0, 0.0, 0.0]), (0, 900, None)]
    return spark.createDataFrame(rows, "flow int, id long, v array<double>").cache()


@pytest.mark.parametrize("per_block", [7, 1_000])
def test_tiles_give_every_pair_once(units, per_block):
    x = blobs()
    got = {(r["flow"], r["id_a"], r["id_b"]): r["d"] for r in tiles.pair_distances(units, ["flow"], "id", per_block=per_block).collect()}
    want = {(g, 100 * g + i, 100 * g + j): float(np.linalg.norm(x[i] - x[j])) for g in (0, 1) for i, j in itertools.combinations(range(len(x)), 2)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(w, abs=1e-12) for k, w in want.items())
    near = tiles.pair_distances(units, ["flow"], "id", within=0.2, per_block=per_block).count()
    assert near == sum(w <= 0.2 for w in want.values())
    least = {(r["flow"], r["id_a"], r["id_b"]): r["b"] for r in tiles.pair_values(units, ["flow"], "id", lambda a, b: a[:, 0] - b[:, 0], name="b", symmetric=False, per_block=per_block).collect()}
    assert all(least[g, a, b] == pytest.approx(x[a - 100 * g, 0] - x[b - 100 * g, 0]) for g, a, b in want)


@pytest.mark.parametrize("per_block", [5, 1_000])
def test_nearest_by_tiles_with_ties(units, per_block):
    x = blobs()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    got: dict = {}
    for r in tiles.nearest(units, ["flow"], "id", 4, per_block=per_block).collect():
        got.setdefault((r["flow"], r["u"]), {})[r["k"]] = r["v"]
    for g in (0, 1):
        for i in range(len(x)):
            order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[i, j], j))[:4]
            assert [got[g, 100 * g + i][k] - 100 * g for k in (1, 2, 3, 4)] == order


def test_no_plan_of_pairs_holds_a_flow(units):
    plan = tiles.nearest(units, ["flow"], "id", 4)._jdf.queryExecution().toString()
    assert "_i" in plan and "_j" in plan


@pytest.mark.parametrize("per_block", [3, 1_024])
def test_scales_of_pairs_in_two_walks(spark, per_block):
    rng = np.random.default_rng(3)
    x = {0: rng.normal(size=(23, 4)), 1: np.ones((6, 4)), 2: rng.normal(size=(2, 4)), 3: rng.normal(size=(1, 4))}
    rows = [(k, 10 * k + i if k else i - 100, v.tolist()) for k, m in x.items() for i, v in enumerate(m)]
    got = tiles.pair_scales(spark.createDataFrame(rows, "k int, id long, v array<double>"), ["k"], "id", per_block=per_block)
    got = {r["k"]: (r["n"], r["mean"], r["median"]) for r in got.collect()}
    for k in (0, 1, 2):
        d = [float(np.linalg.norm(a - b)) for a, b in itertools.combinations(x[k], 2)]
        assert got[k] == pytest.approx((len(d), np.mean(d), np.median(d)))
    assert set(got) == {0, 1, 2}


def test_no_query_of_scores_gathers_the_distances_of_a_flow(spark, sf_dir):
    import __spark_entry__ as entry

    for name in ("distance_scales", "precomputed_silhouette"):
        plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert "percentile(" not in plan and "median(" not in plan and "flight_id_a" not in plan


def test_silhouettes_agree(spark, units):
    lab = units.where("v is not null and flow is not null").withColumn("lab", F.when(F.col("id") % 10 == 9, -1).otherwise((F.col("id") % 100 / 20).cast("int")))
    edges = tiles.pair_distances(units, ["flow"], "id", per_block=9)
    a = {r["flow"]: r["silhouette"] for r in evaluate.silhouette(lab, ["flow"], "id", "lab").collect()}
    b = {r["flow"]: r["silhouette"] for r in evaluate.silhouette_of_edges(edges, lab, ["flow"], "id", "lab").collect()}
    assert a == pytest.approx(b) and set(a) == {0, 1}
    d = spark.createDataFrame([(0, 0, 1, 1.0), (0, 0, 2, 5.0), (0, 1, 2, 4.0)], "flow int, id_a int, id_b int, d double")
    three = spark.createDataFrame([(0, 0, 0), (0, 1, 0), (0, 2, 1)], "flow int, id int, lab int")
    assert evaluate.silhouette_of_edges(d, three, ["flow"], "id", "lab").first()["silhouette"] == pytest.approx(0.516667, abs=1e-6)


def test_precomputed_scores_and_their_reasons(spark, units):
    u = units.where("v is not null and flow is not null").select("flow", "id", "v")
    full = tiles.pair_distances(u, ["flow"], "id")
    lab = u.select("flow", "id", (F.col("id") % 100 / 20).cast("int").alias("cluster_id"))
    rows = {r["flow"]: r for r in matrix.scores(lab, full, ["flow"], "id").collect()}
    assert rows[0]["reason"] is None and rows[0]["silhouette"] > 0.5 and rows[0]["davies_bouldin"] < 1
    thin = full.where("id_a % 2 = 0")
    rows = {r["flow"]: r for r in matrix.scores(lab, thin, ["flow"], "id").collect()}
    assert rows[0]["reason"] == "sparse" and rows[0]["silhouette"] is None
    old = {r["flow"]: r for r in matrix.scores(lab, thin, ["flow"], "id", absent_is_zero=True).collect()}
    assert old[0]["reason"] is None and old[0]["silhouette"] is not None
    one = lab.withColumn("cluster_id", F.lit(0))
    assert {r["reason"] for r in matrix.scores(one, full, ["flow"], "id").collect()} == {"<2 clusters"}


def test_sparse_tables_components_and_cache(spark, units, tmp_path):
    x = blobs()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    u = units.where("v is not null and flow is not null")
    edges = matrix.sparse(u, ["flow"], "id", "v", "euclidean", k=6, quantile=0.9, scale=1.5, dims=3)
    directed = sorted(w for i in range(len(x)) for w in sorted(np.delete(d[i], i))[:6])
    tau = float(np.quantile(directed, 0.9)) * 1.5
    near = tiles.nearest(u, ["flow"], "id", 6)
    assert {r["flow"]: r["tau"] for r in matrix.tau(near, ["flow"], 0.9, 1.5).collect()} == pytest.approx({0: tau, 1: tau})
    assert {r["tau"] for r in matrix.tau(near, ["flow"], explicit=2.5).collect()} == {2.5}
    got = {(r["id_a"], r["id_b"]): r["d"] for r in edges.where("flow = 0").collect()}
    want = {(min(i, j), max(i, j)) for i in range(len(x)) for j in sorted((k for k in range(len(x)) if k != i), key=lambda k: (d[i, k], k))[:6] if d[i, j] <= tau}
    assert set(got) == want and all(got[p] == pytest.approx(d[p]) for p in want)
    lab = {(r["flow"], r["id"]): r["cluster_id"] for r in matrix.cluster_components(u, edges, ["flow"], "id", min_cluster_size=6, min_samples=3).collect()}
    assert len(lab) == 2 * len(x)
    of = np.array([lab[0, i] for i in range(len(x))])
    assert all(len(set(TRUTH[of == k].tolist())) == 1 for k in set(of.tolist()) - {-1}) and of.max() >= 1
    assert of[of >= 0][0] == 0 and [lab[1, 100 + i] for i in range(len(x))] == of.tolist()
    calls = []

    def build():
        calls.append(1)
        return edges

    recipe = matrix.recipe("euclidean", ["flow"], "id", k=6)
    for _ in range(2):
        assert matrix.cached(spark, str(tmp_path), recipe, build).count() == edges.count()
    assert len(calls) == 1


def test_sanitised_tables(spark):
    rows = [(0, 1, 2, 1.0), (0, 2, 1, 3.0), (0, 1, 1, 5.0), (0, 2, 3, 2.0)]
    d = spark.createDataFrame(rows, "flow int, id_a int, id_b int, d double")
    assert sorted(map(tuple, matrix.sanitised(d, ["flow"], "id").collect())) == [(0, 1, 2, 2.0), (0, 2, 3, 2.0)]
    with pytest.raises(ValueError, match="1 distances are not finite"):
        matrix.sanitised(d.union(spark.createDataFrame([(0, 1, 4, float("inf"))], d.schema)), ["flow"], "id")


def test_optics_relaxes_a_thin_table(units):
    u = units.where("v is not null and flow is not null")
    thin = matrix.sparse(u, ["flow"], "id", "v", "euclidean", k=1, quantile=None, dims=3)
    even = u.withColumn("v", F.concat("v", F.array(F.lit(0.0))))  # points of two dimensions
    lab, how = matrix.optics(even, thin, ["flow"], "id", "v", "euclidean", min_samples=5)
    assert how == "relaxed" and lab.where("flow = 0 and cluster_id >= 0").select("cluster_id").distinct().count() >= 2


def test_dense_clusters_need_every_pair(units):
    u = units.where("v is not null and flow = 0")
    full = tiles.pair_distances(u, ["flow"], "id")
    lab = {r["id"]: r["cluster_id"] for r in matrix.cluster_dense(u, full, ["flow"], "id", "agglomerative", n_clusters=3).collect()}
    assert same_groups(np.array([lab[i] for i in range(len(TRUTH))]), TRUTH)
    with pytest.raises(Exception, match="pairs are missing"):
        matrix.cluster_dense(u, full.where("id_a > 0"), ["flow"], "id", "agglomerative", n_clusters=3).count()


def test_envelope_bound_is_a_bound(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(30, 20)), rng.normal(size=(30, 20))
    bound = distance.keogh(3)(a, b)
    # Both coordinates the same series: the squared cost doubles.
    warped = distance.dtw(a[:, :, None], b[:, :, None], "symmetric1", window=3, cost="squared") ** 2
    assert (bound <= warped + 1e-9).all() and (bound > 0).any()
    by_hand = [sum(max(a[k, i] - b[k, max(0, i - 3) : i + 4].max(), b[k, max(0, i - 3) : i + 4].min() - a[k, i], 0) ** 2 for i in range(20)) for k in range(30)]
    assert bound == pytest.approx(by_hand)


def flights_by_hand(points, gap_s, jump):
    out, seq = {}, {}
    state: dict = {}
    for flow, t, i, ident, dist in sorted(points, key=lambda p: (p[0], p[1], p[2])):
        s = state.get(flow)
        if s is None:
            seq[flow], delta = 1, None
        else:
            step = None if dist is None or s["dist"] is None else dist - s["dist"]
            cut = t - s["t"] > gap_s or (ident is not None and s["ident"] is not None and ident != s["ident"]) or (step is not None and abs(step) > jump)
            cut = cut or (step is not None and s["delta"] is not None and step * s["delta"] < 0)
            seq[flow] += cut
            delta = None if cut else step
        state[flow] = {"t": t, "dist": dist, "ident": ident, "delta": delta}
        out[i] = seq[flow]
    return out


@pytest.mark.parametrize("slices", [1, 3, 50])
def test_segments_do_not_depend_on_slices(spark, slices):
    rng = random.Random(7)
    points, t = [], 0
    for i in range(600):
        t += rng.choice([1, 1, 1, 2, 400])
        points.append((rng.choice(["a", "a", "a", "b"]), t, i, rng.choice(["x", "x", "x", "y", None]), rng.choice([float(rng.randint(0, 30)), 5.0, 5.0])))
    points.append(("c", 1, 600, None, None))
    d = spark.createDataFrame(points, "flow string, t long, i long, ident string, dist double").withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz")).repartition(5)
    got = segment.segment_flights(d, ["flow"], ["ts", "i"], "ts", "dist", ["ident"], 300, 20, dense=False, slices=slices)
    assert {r["i"]: r["flight_seq"] for r in got.collect()} == flights_by_hand(points, 300, 20)
    assert set(got.columns) == {*d.columns, "flight_seq"}


def test_ranks_and_quantiles_by_slices(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *map(float, range(12))]), i) for i in range(400)]
    d = spark.createDataFrame(rows, "k string, x double, i long").repartition(4)
    got = {r["i"]: r["rank"] for r in ranks.ranked_rows(d, ["k"], ["x", "i"], slices=9).collect()}
    for k in ("a", "b", None):
        order = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in order] == list(range(1, len(order) + 1))
    q = {r["k"]: (r["lo"], r["hi"]) for r in ranks.quantiles(d, ["k"], "x", {"lo": 0.1, "hi": 0.77}).collect()}
    for k in ("a", "b", None):
        x = [r[1] for r in rows if r[0] == k and r[1] is not None]
        assert q[k] == pytest.approx((np.quantile(x, 0.1), np.quantile(x, 0.77)))
    assert ranks.quantiles(d.limit(0), [], "x", {"m": 0.5}).count() in (0, 1)


def test_axes_against_a_singular_value_decomposition(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 6)) * [5, 3, 2, 1, 0.5, 0.1]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    mean, axes, shares = features.principal_axes(d, "v", 3)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert mean == pytest.approx(x.mean(0)) and shares == pytest.approx((s**2 / (s**2).sum())[:3])
    for k in range(3):
        assert abs(axes[:, k] @ vt[k]) == pytest.approx(1) and axes[np.abs(axes[:, k]).argmax(), k] > 0
    pc = np.array([r["pc"] for r in features.project(d, "v", mean, axes).orderBy("id").collect()])
    assert pc == pytest.approx((x - x.mean(0)) @ axes)


def test_simplification_by_recursion():
    rng = np.random.default_rng(5)

    def keep(p, a, b, eps):
        if b - a < 2:
            return set()
        seg = p[b] - p[a]
        far = []
        for i in range(a + 1, b):
            u = min(1.0, max(0.0, float((p[i] - p[a]) @ seg) / float(seg @ seg))) if seg @ seg > 0 else 0.0
            far.append(float(np.linalg.norm(p[i] - p[a] - u * seg)))
        k = int(np.argmax(far))
        return {a + 1 + k} | keep(p, a, a + 1 + k, eps) | keep(p, a + 1 + k, b, eps) if far[k] > eps else set()

    for _ in range(20):
        p = np.cumsum(rng.normal(size=(40, 2)), axis=0)
        assert set(np.flatnonzero(resample.simplify_mask(p, 1.0))) == {0, 39} | keep(p, 0, 39, 1.0)


def test_pchip_is_monotone_and_meets_its_points():
    t = np.array([0.0, 1.0, 2.5, 3.0, 5.0, 6.0])
    v = np.array([0.0, 2.0, 2.0, 3.0, 8.0, 7.0])
    at = np.linspace(0, 6, 601)
    got = resample.pchip(t, v, at)
    assert resample.pchip(t, v, t) == pytest.approx(v)
    for a, b, x, y in zip(t, t[1:], v, v[1:], strict=False):
        part = got[(at >= a) & (at <= b)]
        assert (np.diff(part) * np.sign(y - x) >= -1e-12).all() if x != y else part == pytest.approx(x)
    # A quadratic's slopes between three points, by the three-point formula and the weighted harmonic mean.
    assert resample.pchip(np.array([0.0, 1.0, 2.0]), np.array([0.0, 1.0, 4.0]), np.array([0.5]))[0] == pytest.approx(0.5 + (0.0 - 1.5) / 8)


def test_spline_reproduces_a_cubic_and_ground_tracks_keep_their_ends():
    t = np.array([0.0, 1.0, 2.0, 4.0, 5.0])
    f = lambda x: 1 + 2 * x - 0.5 * x**2 + 0.1 * x**3
    at = np.linspace(0, 5, 51)
    assert side.spline(t, f(t), at) == pytest.approx(f(at))
    g = side.ground_track(np.array([5.0, 1_000, 2_000, 2_000]), np.array([5.0, 0, 0, 0]), start=(0.0, 0.0))
    assert g[0] == pytest.approx([0, 0, 0]) and g[-1] == pytest.approx([2_000, 0, 2_000]) and np.diff(g[:, 2]) == pytest.approx([200] * 10)


def test_smoothing_in_chunks_and_short_tracks(spark):
    x = [float(i % 7) for i in range(200)]
    want = [x[0]]
    for v in x[1:]:
        want.append(want[-1] * (1 - 2 / 6) + v * 2 / 6)
    got = spark.createDataFrame([(x,), ([],), (None,)], "x array<double>").select(signal.ewm(F.col("x"), 5)).collect()
    assert got[0][0] == pytest.approx(want) and got[1][0] == [] and got[2][0] is None
    d = spark.createDataFrame([("a", i, float(i * i)) for i in range(4)], "k string, i int, x double")
    assert [r["x"] for r in signal.savgol(d, ["k"], ["i"], ["x"], width=4, degree=2).orderBy("i").collect()] == [0, 1, 4, 9]  # an even width grows to 5


def test_filled_gaps_and_representations(spark):
    nan = float("nan")
    rows = [([None, 1.0, nan, None, 4.0, None],), ([None, nan],), ([],), ([2.0],), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<double>").select(features.fill_gaps(F.col("a"))).collect()]
    assert got[0] == pytest.approx([1, 1, 2, 3, 4, 4]) and got[1:4] == [None, None, [2.0]] and got[4] is None
    t = spark.createDataFrame([(1, [0.0, 1.0, 1.0, 3.0], [0.0, 2.0, 9.0, 6.0]), (2, [5.0, 5.0], [1.0, 3.0]), (3, [0.0, 1.0], [4.0, 4.0])], "id int, t array<double>, x array<double>")
    out = {r["id"]: (r["x"], r["constant"]) for r in resample.represent(t, ["x"], 4, "t").collect()}
    assert out[1][0] == pytest.approx([0, 2, 4, 6]) and out[2][0] == pytest.approx([1, 5 / 3, 7 / 3, 3]) and out[3] == ([4.0] * 4, True) and not out[1][1]


def test_speed_profiles(spark):
    rows = [("a", float(i), 3.0 * i, 4.0 * i, None if i else 100.0) for i in range(5)]
    p = spark.createDataFrame(rows, "id string, t double, x double, y double, gs double")
    got = resample.speed_profile(p, ["id"], ["t"], "x", "y", "t", 5, "gs").first()["speed"]
    assert got == pytest.approx([51.4444, 5, 5, 5, 5])


def plain_affinity(x, damping=0.7, iterations=200):
    """Messages in whole matrices, over all units."""
    s = -((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(s, np.median(s))
    n = len(s)
    r, a = np.zeros((n, n)), np.zeros((n, n))
    for _ in range(iterations):
        v = a + s
        new = np.array([[s[i, k] - np.delete(v[i], k).max() for k in range(n)] for i in range(n)])
        r = damping * r + (1 - damping) * new
        p = np.where(np.eye(n, dtype=bool), r, np.maximum(r, 0))
        new = p.sum(0) - p
        a = damping * a + (1 - damping) * np.where(np.eye(n, dtype=bool), new, np.minimum(new, 0))
    found = np.flatnonzero(np.diag(a + r) > 0)
    return found[((x[:, None] - x[found]) ** 2).sum(2).argmin(1)]


@pytest.mark.parametrize(("cells", "matrix_bytes"), [(cluster._CELLS, cluster.MATRIX_BYTES), (300, cluster.MATRIX_BYTES), (300, 0)])
def test_affinity_messages_are_those_of_whole_matrices(monkeypatch, cells, matrix_bytes):
    monkeypatch.setattr(cluster, "_CELLS", cells)
    monkeypatch.setattr(cluster, "MATRIX_BYTES", matrix_bytes)
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, 0.5, (12, 3)) + k for k in (0, 2, 4)] + [rng.normal(0, 3, (9, 3))])
    lab = cluster.affinity_propagation(x, iterations=60)
    assert same_groups(lab, plain_affinity(x, iterations=60)) and len(set(lab)) > 3


def test_affinity_seeks_exemplars_on_all_units():
    rng = np.random.default_rng(3)
    far = np.random.default_rng(0).permutation(2_100)[2_000:2_003]  # away from the others, none among the 2,000 that were drawn before
    x = rng.normal(0, 1, (2_100, 16))
    x[far] = 40 + np.array([[0.0], [0.1], [-0.2]])
    lab = cluster.affinity_propagation(x, iterations=100)
    assert lab.min() >= 0 and len(set(lab[far])) == 1 and not set(lab[far]) & set(np.delete(lab, far))


def test_the_median_of_blocks_is_exact():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 1_000):
        x = rng.choice([0.0, 1e-300, 0.5, *rng.exponential(3, 40)], n)
        assert cluster.median_of(lambda x=x: iter(np.array_split(x, 3)), n) == np.median(x)
