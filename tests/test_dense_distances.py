"""LCSS, and the dense forms of the warping distances and Frechet's, cover every pair of a flow."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from trajspark.operators import distance, tiles
from trajspark.plans import scores


def rows(df):
    return {(r["flight_id_a"], r["flight_id_b"]): r["d"] for r in df.collect()}


def test_lcss_has_every_pair(spark, sf_dir):
    assert set(rows(scores.lcss_distance(spark, sf_dir))) == set(rows(scores.pairwise_euclid(spark, sf_dir)))


@pytest.mark.parametrize("name", ["dtw_symmetric2", "dtw_symmetric1", "dtw_banded", "frechet_discrete"])
def test_dense_form_has_every_pair(name, spark, sf_dir):
    sparse, dense = rows(getattr(scores, name)(spark, sf_dir)), rows(getattr(scores, name + "_dense")(spark, sf_dir))
    assert set(dense) == set(rows(scores.pairwise_euclid(spark, sf_dir)))
    assert sparse.items() <= dense.items()


def test_sparse_form_takes_more_neighbours(spark, sf_dir):
    few, more = rows(scores._dp(spark, sf_dir, "dtw")), rows(scores._dp(spark, sf_dir, "dtw", k=30))
    assert few.items() < more.items()


@pytest.mark.parametrize("n,m", [(1, 1), (5, 9), (32, 32), (40, 64), (64, 40), (20, 70)])
def test_lcss_is_the_textbook_one(n, m):
    rng = np.random.default_rng(n * m)
    a, b = rng.normal(size=(7, n, 2)), rng.normal(size=(7, m, 2))
    least = min(n, m)
    delta = 1 if least <= 1 else max(1, int(np.ceil(0.3 * least)))
    want = []
    for x, y in zip(a, b, strict=True):
        share = 0.0
        for axis in (0, 1):
            g = np.zeros((n + 1, m + 1), int)
            for i in range(n):
                for j in range(m):
                    hit = abs(x[i, axis] - y[j, axis]) <= 0.7 and abs(i - j) <= delta
                    g[i + 1, j + 1] = g[i, j] + 1 if hit else max(g[i, j + 1], g[i + 1, j])
            share += g[n, m] / least
        want.append(min(max(1 - share / 2, 0), 1))
    assert distance.lcss(a, b, 0.7, 0.3) == pytest.approx(want)


def textbook(x, y, radius, diagonal, cost, better):
    g = np.full((len(x), len(y)), np.inf)
    for i in range(len(x)):
        for j in range(len(y)):
            if abs(i - j) > radius:
                continue
            c = cost(x[i], y[j])
            before = [g[p, q] for p, q in ((i - 1, j), (i, j - 1)) if p >= 0 and q >= 0]
            corner = g[i - 1, j - 1] if i and j else np.inf
            g[i, j] = c if i == j == 0 else better(c, min([np.inf, *before]), corner, diagonal)
    return g[-1, -1]


def euclid(p, q):
    return np.sqrt(((p - q) ** 2).sum())


@pytest.mark.parametrize("n,m", [(1, 1), (1, 6), (5, 9), (9, 5), (32, 32)])
@pytest.mark.parametrize("radius", [None, 0, 1, 4])
def test_warping_is_the_textbook_one(n, m, radius):
    rng = np.random.default_rng(n + m)
    a, b = rng.normal(size=(5, n, 2)), rng.normal(size=(5, m, 2))
    add = lambda c, beside, corner, diagonal: min(beside + c, corner + diagonal * c)
    r = max(n, m) if radius is None else radius
    for pattern, diagonal in (("symmetric2", 2), ("symmetric1", 1)):
        want = [textbook(x, y, r, diagonal, euclid, add) for x, y in zip(a, b, strict=True)]
        assert distance.dtw(a, b, pattern, radius) == pytest.approx(want)
    want = [np.sqrt(textbook(x, y, max(r, abs(n - m)), 1, lambda p, q: euclid(p, q) ** 2, add)) for x, y in zip(a, b, strict=True)]
    assert distance.dtw(a, b, "symmetric1", radius, "squared", True) == pytest.approx(want)


def held(f, *args):
    import tracemalloc

    tracemalloc.start()
    f(*args)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


@pytest.mark.parametrize("name", ["dtw", "dtw_symmetric1", "dtw_banded", "frechet", "lcss"])
def test_distances_hold_no_table_of_cells(name):
    """What it holds does not grow with the pairs, as it takes them in parts that stay in the caches."""
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 8_192, 32, 2))
    assert held(distance.metric(name), a, b) < 8 * 8_192 * 32 * 32 / 4


@pytest.mark.parametrize("n,m", [(1, 1), (6, 6), (9, 7), (32, 32)])
@pytest.mark.parametrize("options", [{}, {"pattern": "symmetric1"}, {"pattern": "symmetric1", "window": 4, "cost": "squared"}, {"window": 0}, {"window": 1, "widen": True}])
def test_crossed_tracks_are_each_with_each(n, m, options):
    rng = np.random.default_rng(n * m)
    a, b = rng.normal(size=(13, n, 2)), rng.normal(size=(600, m, 2))
    i, j = np.divmod(np.arange(13 * 600), 600)
    paired = distance.dtw(a[i], b[j], **options).reshape(13, 600)
    assert (distance.dtw(a[:, None], b[None], **options) == paired).all()
    assert (distance.frechet(a[:, None], b[None]) == distance.frechet(a[i], b[j]).reshape(13, 600)).all()


def test_crossed_tiles_have_the_same_pairs(spark, sf_dir):
    v, f = scores.vectors(spark, sf_dir), distance.flat_measure("dtw_banded", window=4)
    got = [rows(tiles.pair_values(v, ["flow"], "flight_id", f, crossed=c, per_block=b)) for c in (True, False) for b in (8, 512)]
    assert len(got[0]) > 100 and all(g == got[0] for g in got)


def test_only_the_band_is_held():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, 64, 4_000, 1))
    tracemalloc.start()
    distance.dtw(a, b, "symmetric1", window=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * a.nbytes  # the two tracks again, and a few antidiagonals


@pytest.mark.parametrize("rows_,others,n,m", [(1, 1, 3, 3), (7, 1_500, 6, 5), (130, 517, 32, 32), (3, 2_049, 1, 4)])
def test_arrays_of_a_program_serve_every_batch(monkeypatch, rows_, others, n, m):
    """A few programs take all pairs, in whole cache lines, and nothing of one batch is left in the next."""
    made, begin = [], distance._Program.__init__

    def poisoned(self, *args):
        begin(self, *args)
        made.append(self)
        for s in (self.costs, self.near, *self.states):
            s.fill(-1e9)

    monkeypatch.setattr(distance._Program, "__init__", poisoned)
    rng = np.random.default_rng(others)
    a, b = rng.normal(size=(rows_, n, 2)), rng.normal(size=(others, m, 2))
    got = distance.dtw(a[:, None], b[None], "symmetric1")
    assert 1 <= len(made) <= 4
    assert all(t.ctypes.data % 64 == 0 and t.strides[-2] % 64 == 0 for p in made for t in (p.x, p.y, p.costs, p.near, *p.states))
    add = lambda c, beside, corner, diagonal: min(beside + c, corner + diagonal * c)
    for i, j in zip(rng.integers(rows_, size=20), rng.integers(others, size=20), strict=True):
        assert got[i, j] == pytest.approx(textbook(a[i], b[j], max(n, m), 1, euclid, add))
    few = rng.integers(others, size=50)
    assert (got[:, few] == distance.dtw(np.repeat(a, 50, 0), np.tile(b[few], (rows_, 1, 1)), "symmetric1").reshape(rows_, 50)).all()


def test_symmetric1_is_crossed(monkeypatch):
    monkeypatch.setattr(scores, "_dense", lambda spark, d, name, crossed=False, **options: (name, crossed, options))
    assert scores.dtw_symmetric1_dense(None, None) == ("dtw_symmetric1", True, {})
