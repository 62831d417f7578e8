"""Elastic distances between tracks: NumPy kernels over batches of pairs, one dynamic program for all of them.

A batch holds pairs of one shape; the program runs over antidiagonals and is vectorised along them and across the pairs.
Tracks are flat arrays x0, y0, x1, y1, ... of ``dims`` coordinates.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_INF = np.inf


def _costs(a: np.ndarray, b: np.ndarray, squared: bool) -> np.ndarray:
    d = ((a[:, :, None, :] - b[:, None, :, :]) ** 2).sum(-1)
    return d if squared else np.sqrt(d)


#: Pairs that go through a dynamic program together, and cells of an antidiagonal: few enough for the caches.
_PAIRS = 1_024
_CELLS = 1 << 15
#: Bytes of a cache line: NumPy's loops take up to twice as long over arrays that do not begin with one.
_LINE = 64


def _lined(*shape: int) -> np.ndarray:
    """An empty array that begins with a cache line."""
    size = 8 * int(np.prod(shape))
    raw = np.empty(size + _LINE, np.uint8)
    at = -raw.ctypes.data % _LINE
    return raw[at : at + size].view(float).reshape(shape)


class _Program:
    """A dynamic program over antidiagonals for up to ``pairs`` pairs of (dims, points, pairs) tracks, whose arrays serve again and again.

    Points lead and pairs trail: an antidiagonal is a slice of the one track and a slice of the other one backwards. Of
    an antidiagonal only the cells within ``radius`` are held, between two infinite ones. Each row is whole cache lines.
    """

    def __init__(self, dims: int, n: int, m: int, pairs: int, radius: int):
        width, self.n, self.m, self.radius = -(-pairs * 8 // _LINE) * _LINE // 8, n, m, radius
        high = min(n, m, radius + 1)
        self.x, self.y = _lined(dims, n, width), _lined(dims, m, width)
        self.x[..., pairs:] = self.y[..., pairs:] = 0
        self.costs, self.near = _lined(high, width), _lined(high, width)
        self.states = [_lined(high + 2, width) for _ in range(3)]

    def last(self, root: bool, step: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The last cells of the tracks in ``x`` and, backwards, in ``y``."""
        n, m, radius = self.n, self.m, self.radius
        before, last, now = self.states
        last[:3] = _INF  # the one before the first
        lo = ago = 0
        for k in range(n + m - 1):
            ago, earlier, lo = lo, ago, max(0, k - m + 1, (k - radius + 1) // 2)
            w = min(n, k + 1, (k + radius) // 2 + 1) - lo
            up, corner = lo - ago, lo - earlier
            now[0], now[w + 1] = _INF, _INF
            if w:
                c, near, out = self.costs[:w], self.near[:w], now[1 : w + 1]
                ours, theirs = self.x[:, lo : lo + w], self.y[:, m - 1 - k + lo : m - 1 - k + lo + w]
                for dim, (p, q) in enumerate(zip(ours, theirs, strict=True)):
                    d = np.subtract(p, q, out=near if dim else c)
                    np.multiply(d, d, out=d)
                    if dim:
                        c += d
                if root:
                    np.sqrt(c, out=c)
                if k:
                    step(c, np.minimum(last[up : up + w], last[up + 1 : up + 1 + w], out=near), before[corner : corner + w], out)
                else:
                    out[:] = c
            before, last, now = last, now, before
        return last[1]


def _shares(n: int, most: int) -> Iterator[slice]:
    """Slices of ``n``, as few as hold ``most`` each at most, and about equally long."""
    count = -(-n // most)
    return (slice(n * k // count, n * (k + 1) // count) for k in range(count))


def _last_cells(a: np.ndarray, b: np.ndarray, radius: int, root: bool, step: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The last cell of each pair's dynamic program; cells farther than ``radius`` from the diagonal are infinite.

    Tracks are (pairs, points, dims) on both sides or, for every one with every other one, (units, 1, points, dims) and
    (1, units, points, dims), of which only the pairs at hand are copied. ``step`` gets (costs, least of the cells above and
    to the left, cells before on the diagonal, where the cells belong) and may overwrite the first two. Costs are squared
    distances or, with ``root``, distances.
    """
    n, m, dims, units = a.shape[-2], b.shape[-2], a.shape[-1], np.broadcast_shapes(a.shape[:-2], b.shape[:-2])
    out = np.full(units, _INF)
    if abs(n - m) > radius or not out.size:
        return out
    cells = out.reshape(-1, units[-1])  # pairs that are not crossed are one row
    x, y = (np.broadcast_to(np.moveaxis(t, (-1, -2), (0, 1)), (dims, t.shape[-2], *units)) for t in (a, b[..., ::-1, :]))
    if out.ndim == 1:
        x, y = x[:, :, None], y[:, :, None]
    programs: dict[int, _Program] = {}
    most = max(_PAIRS, min(2 * _PAIRS, _CELLS // min(n, m, radius + 1)))
    for at in _shares(cells.shape[1], _PAIRS):
        for rows in _shares(len(cells), max(1, most // (at.stop - at.start))):
            part = rows.stop - rows.start, at.stop - at.start
            pairs = part[0] * part[1]
            program = programs.get(pairs) or programs.setdefault(pairs, _Program(dims, n, m, pairs, radius))
            program.x[..., :pairs].reshape(dims, n, *part)[...] = x[:, :, rows, at]
            program.y[..., :pairs].reshape(dims, m, *part)[...] = y[:, :, rows, at]
            cells[rows, at] = program.last(root, step)[:pairs].reshape(part)
    return out


def dtw(a: np.ndarray, b: np.ndarray, pattern: str = "symmetric2", window: int | None = None, cost: str = "euclid", widen: bool = False) -> np.ndarray:
    """Warping distance of each pair of (pairs, points, dims) arrays, or of all crossed pairs as ``_last_cells`` has them.

    symmetric2 counts a diagonal step twice, symmetric1 once. ``window`` is the Sakoe-Chiba radius,
    infinite distances mean that it admits no path; ``widen`` raises it to the difference of the lengths. With cost
    'squared' the result is the root of the summed squares.
    """
    n, m = a.shape[-2], b.shape[-2]
    r = max(n, m) if window is None else max(window, abs(n - m)) if widen else window

    def once(c: np.ndarray, beside: np.ndarray, diagonal: np.ndarray, to: np.ndarray) -> np.ndarray:
        np.minimum(beside, diagonal, out=beside)
        return np.add(beside, c, out=to)

    def twice(c: np.ndarray, beside: np.ndarray, diagonal: np.ndarray, to: np.ndarray) -> np.ndarray:
        beside += c
        np.multiply(c, 2.0, out=c)
        c += diagonal
        return np.minimum(beside, c, out=to)

    out = _last_cells(a, b, r, cost != "squared", twice if pattern == "symmetric2" else once)
    return np.sqrt(out) if cost == "squared" else out


def frechet(a: np.ndarray, b: np.ndarray, tau: float | None = None) -> np.ndarray:
    """Discrete Frechet distance; beyond ``tau`` it is infinite."""

    def step(c: np.ndarray, beside: np.ndarray, diagonal: np.ndarray, to: np.ndarray) -> np.ndarray:
        np.minimum(beside, diagonal, out=beside)
        return np.maximum(beside, c, out=to)

    out = np.sqrt(_last_cells(a, b, max(a.shape[-2], b.shape[-2]), False, step))  # the root keeps the order, so that one will do
    return out if tau is None else np.where(out <= tau, out, _INF)


def _common_bits(a: np.ndarray, b: np.ndarray, epsilon: float, delta: int) -> np.ndarray:
    """Length of the longest common subsequence of (points, pairs) values, b of at most 64 points: a row is one word, its steps are carries.

    Only the cells at most ``delta`` from the diagonal are looked at; no other can match.
    """
    n, m = len(a), len(b)
    words = np.zeros(a.shape, np.uint64)
    places = np.arange(m, dtype=np.uint64)[:, None]
    for k in range(max(-delta, 1 - n), min(delta, m - 1) + 1):
        lo, hi = max(0, -k), min(n, m - k)  # rows i whose cell i + k exists
        if lo < hi:
            d = a[lo:hi] - b[lo + k : hi + k]
            hit = (np.abs(d, out=d) <= epsilon).astype(np.uint64)
            words[lo:hi] |= np.left_shift(hit, places[lo + k : hi + k], out=hit)
    v = np.full(a.shape[1], np.iinfo(np.uint64).max, np.uint64)
    for word in words:
        u = v & word
        v = (v + u) | (v - u)
    return np.bitwise_count(~v).astype(int)


def lcss(a: np.ndarray, b: np.ndarray, epsilon: float = 1.0, alpha: float = 0.1) -> np.ndarray:
    """1 minus the mean over axes of the longest common subsequence's share of the shorter track, clipped to 0..1."""
    n, m = a.shape[1], b.shape[1]
    least = min(n, m)
    delta = 1 if least <= 1 else max(1, int(np.ceil(alpha * least)))
    total = np.zeros(len(a))
    for axis in range(a.shape[2]):
        if m <= 64:
            for k in range(0, len(a), _PAIRS):
                x, y = (np.ascontiguousarray(t[k : k + _PAIRS, :, axis].T) for t in (a, b))
                total[k : k + _PAIRS] += _common_bits(x, y, epsilon, delta) / least
            continue
        near = np.abs(a[:, :, None, axis] - b[:, None, :, axis]) <= epsilon
        prev = np.zeros((len(a), m + 1), int)
        for i in range(n):
            row = np.zeros_like(prev)
            for j in range(m):
                hit = near[:, i, j] & (abs(i - j) <= delta)
                row[:, j + 1] = np.where(hit, prev[:, j] + 1, np.maximum(prev[:, j + 1], row[:, j]))
            prev = row
        total += prev[:, m] / least
    return np.clip(1 - total / a.shape[2], 0, 1)


def euclid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.shape != b.shape:
        raise ValueError("euclidean distance needs tracks of equal length")
    return np.sqrt(((a - b) ** 2).sum((1, 2)))


METRICS: dict[str, Callable[..., np.ndarray]] = {
    "euclidean": euclid,
    "dtw": dtw,
    "dtw_symmetric1": functools.partial(dtw, pattern="symmetric1"),
    "dtw_banded": functools.partial(dtw, pattern="symmetric1", cost="squared", widen=True),
    "frechet": frechet,
    "lcss": lcss,
}


def metric(name: str) -> Callable[..., np.ndarray]:
    """A metric by its name; an unknown one is an error."""
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; one of {', '.join(METRICS)}")
    return METRICS[name]


def flat_measure(name: str, dims: int = 2, **options) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A metric over rows of flat tracks of one length, for tiles; those of warping and Frechet's take crossed rows too."""
    f = functools.partial(metric(name), **options)

    def measure(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        for m in (a, b):
            if m.shape[-1] % dims:
                raise ValueError(f"{m.shape[-1]} values are no points of {dims} dimensions")
            if not np.isfinite(m).all():
                raise ValueError("tracks must be finite")
        return f(a.reshape(*a.shape[:-1], -1, dims), b.reshape(*b.shape[:-1], -1, dims))

    return measure


def keogh(radius: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Lower bounds of the squared-cost warping distance: what the first series leave of the second ones' envelopes."""

    def measure(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        padded = np.pad(b, ((0, 0), (radius, radius)), constant_values=np.nan)
        around = np.lib.stride_tricks.sliding_window_view(padded, 2 * radius + 1, axis=1)
        lo, hi = np.fmin.reduce(around, axis=2), np.fmax.reduce(around, axis=2)
        return (np.maximum(np.maximum(a - hi, lo - a), 0.0) ** 2).sum(1)

    return measure


def track(values: Sequence[float], dims: int) -> np.ndarray:
    """A flat array as (points, dims); NaN or a ragged length is an error."""
    a = np.asarray(values, float)
    if len(a) % dims:
        raise ValueError(f"{len(a)} values are no points of {dims} dimensions")
    if not np.isfinite(a).all():
        raise ValueError("tracks must be finite")
    return a.reshape(-1, dims)


def with_distance(pairs: DataFrame, a: str, b: str, name: str = "dtw", out: str = "d", dims: int = 2, step: int = 512, **options) -> DataFrame:
    """Add the distance of two flat-array columns; batches of equal shapes go through the kernel together, ``step`` at a time."""
    f = functools.partial(metric(name), **options)
    drop = [a, b]
    keep = [c for c in pairs.columns if c not in drop]
    schema = ", ".join(f"`{c}` {t}" for c, t in pairs.select(*keep).dtypes) + f", `{out}` double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, y = [track(v, dims) for v in batch[a]], [track(v, dims) for v in batch[b]]
            d = np.empty(len(batch))
            shapes: dict[tuple[int, int], list[int]] = {}
            for i in range(len(batch)):
                shapes.setdefault((len(x[i]), len(y[i])), []).append(i)
            for at in shapes.values():
                for k in range(0, len(at), step):
                    part = at[k : k + step]
                    d[part] = f(np.stack([x[i] for i in part]), np.stack([y[i] for i in part]))
            yield batch[keep].assign(**{out: d})

    doubles = pairs.withColumns({c: F.col(c).cast("array<double>") for c in drop})
    return doubles.select(*keep, *drop).mapInPandas(run, schema)


def warp_path(a: np.ndarray, b: np.ndarray, pattern: str = "symmetric2") -> list[tuple[int, int, float, float]]:
    """(i, j, local, cumulative) along the best warping path; equal costs: diagonal, then up, then left."""
    d = _costs(a[None], b[None], False)[0]
    n, m = d.shape
    diag = 2.0 if pattern == "symmetric2" else 1.0
    g = np.full((n, m), _INF)
    for i in range(n):
        for j in range(m):
            g[i, j] = d[i, j] if i == j == 0 else min(g[i - 1, j - 1] + diag * d[i, j] if i and j else _INF, g[i - 1, j] + d[i, j] if i else _INF, g[i, j - 1] + d[i, j] if j else _INF)
    path, i, j = [], n - 1, m - 1
    while True:
        path.append((i, j, float(d[i, j]), float(g[i, j])))
        if i == j == 0:
            return path[::-1]
        steps = [(g[i - 1, j - 1] + diag * d[i, j], i - 1, j - 1)] if i and j else []
        steps += [(g[i - 1, j] + d[i, j], i - 1, j)] if i else []
        steps += [(g[i, j - 1] + d[i, j], i, j - 1)] if j else []
        _, i, j = min(steps, key=lambda s: s[0])


def frechet_path(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, float, float]]:
    """(i, j, local, cumulative) along the coupling, walked back: equal values prefer up, then left, then diagonal."""
    d = _costs(a[None], b[None], False)[0]
    n, m = d.shape
    c = np.empty((n, m))
    for i in range(n):
        for j in range(m):
            before = [c[p, q] for p, q in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if p >= 0 and q >= 0]
            c[i, j] = max(d[i, j], min(before)) if before else d[i, j]
    path, i, j = [], n - 1, m - 1
    while True:
        path.append((i, j, float(d[i, j]), float(c[i, j])))
        if i == j == 0:
            return path[::-1]
        _, i, j = min(((c[p, q], p, q) for p, q in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if p >= 0 and q >= 0), key=lambda s: s[0])


def path_rows(pairs: DataFrame, a: str, b: str, kind: str = "dtw", dims: int = 2) -> DataFrame:
    """One row for each step of each pair's alignment: place, i, j, local, cumulative."""
    keep = [c for c in pairs.columns if c not in (a, b)]
    schema = ", ".join(f"`{c}` {t}" for c, t in pairs.select(*keep).dtypes) + ", place int, i int, j int, local double, cumulative double"
    walk = warp_path if kind == "dtw" else frechet_path

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                for k, (i, j, local, total) in enumerate(walk(track(r[a], dims), track(r[b], dims))):
                    rows.append({**{c: r[c] for c in keep}, "place": k, "i": i, "j": j, "local": local, "cumulative": total})
            yield pd.DataFrame(rows, columns=[*keep, "place", "i", "j", "local", "cumulative"])

    doubles = pairs.withColumns({c: F.col(c).cast("array<double>") for c in (a, b)})
    return doubles.mapInPandas(run, schema)
