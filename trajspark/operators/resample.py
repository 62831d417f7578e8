"""Resampling and simplification of tracks held as ordered arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import at, by_domain, by_index


def _field(name: str) -> Callable[[Column], Column]:
    return lambda p: p[name]


def collect_tracks(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], meta: Sequence[str] = ()) -> DataFrame:
    """One row a track: an ordered array of each column, ``n``, and the first row's metadata."""
    s = F.array_sort(F.collect_list(F.struct(*order, *[c for c in cols if c not in order], *[c for c in meta if c not in order and c not in cols])))
    g = df.groupBy(*keys).agg(s.alias("_p"))
    # By a lambda, which is evaluated once: a field taken out of an array of structs would be inlined wherever it is used, and rebuilt there.
    out = [F.transform("_p", _field(c)).alias(c) for c in cols]
    return g.select(*keys, F.size("_p").alias("n"), *out, *[F.get("_p", F.lit(0))[m].alias(m) for m in meta])


def to_steps(tracks: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row a point, with ``step`` from 0."""
    z = tracks.select(*[c for c in tracks.columns if c not in cols], F.posexplode(F.arrays_zip(*[F.col(c) for c in cols])).alias("step", "_z"))
    return z.select(*[c for c in z.columns if c != "_z"], *[F.col(f"_z.{c}").alias(c) for c in cols])


def resample(tracks: DataFrame, cols: Sequence[str], n: int, domain: str | None = None) -> DataFrame:
    """Arrays of ``n`` points: evenly by index, or by an ascending domain (time, chainage), which is resampled too."""
    if domain is None:
        return tracks.withColumns({c: by_index(F.col(c).cast("array<double>"), n) for c in cols})
    typed = tracks.withColumns({c: F.col(c).cast("array<double>") for c in [domain, *cols]})
    t = F.col(domain)
    done = typed.withColumns({f"_{c}": by_domain(t, F.col(c), n) for c in cols})
    lo, hi = at(t, F.lit(0)), F.element_at(t, -1)
    done = done.withColumn(domain, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.when(k == n - 1, hi).otherwise(lo + (hi - lo) * k / float(max(n - 1, 1)))))
    return done.withColumns({c: F.col(f"_{c}") for c in cols}).drop(*[f"_{c}" for c in cols])


def represent(tracks: DataFrame, cols: Sequence[str], n: int, domain: str) -> DataFrame:
    """``resample`` along a domain, or by index where the domain is constant or unknown; ``constant`` marks tracks that never move.

    Points of one domain value count once, the first of them.
    """
    typed = tracks.withColumns({c: F.col(c).cast("array<double>") for c in [domain, *cols]})
    t = F.col(domain)
    first = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (at(t, i) != at(t, i - 1)))
    typed = typed.where(F.size(t) > 0).withColumn("_first", first)
    moves = F.coalesce(F.forall(t, lambda x: x.isNotNull() & ~F.isnan(x)) & (F.array_min(t) < F.array_max(t)), F.lit(False))
    pick = lambda c: F.transform("_first", _at_place(c))
    typed = typed.withColumns({"_moves": moves, "_t": pick(domain), **{f"_{c}": pick(c) for c in cols}})
    still = reduce(lambda a, b: a & b, [F.array_min(c) == F.array_max(c) for c in cols])
    return typed.select(
        *[c for c in tracks.columns if c not in (domain, *cols, "n")],
        *[F.when(F.col("_moves"), by_domain(F.col("_t"), F.col(f"_{c}"), n)).otherwise(by_index(F.col(c), n)).alias(c) for c in cols],
        F.coalesce(still, F.lit(False)).alias("constant"),
    )


def _at_place(name: str) -> Callable[[Column], Column]:
    return lambda i: F.get(F.col(name), i)


#: Fixed value: metres a second in a knot.
KNOT = 0.514444


def speed_profile(points: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, y: str, t_s: str, n: int, knots: str | None = None) -> DataFrame:
    """Speed in m/s of each track at ``n`` even places of its way: as reported in knots where known, else from its legs."""
    from .signal import chainage, speeds

    s = speeds(chainage(points, keys, order, x, y, "_way"), keys, order, x, y, t_s)
    if knots:
        s = s.withColumn("speed", F.coalesce(F.col(knots) * KNOT, "speed"))
    t = collect_tracks(s.where(F.col("speed").isNotNull()), keys, order, ["_way", "speed"])
    return represent(t, ["speed"], n, "_way").drop("constant")


def average_duplicates(df: DataFrame, keys: Sequence[str], index: str, cols: Sequence[str], least: int = 2) -> DataFrame:
    """Points of one index become their mean; rows with a null or non-finite value go, as do tracks with fewer than ``least`` points."""
    ok = F.lit(True)
    for c in [index, *cols]:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    g = df.where(ok).groupBy(*keys, index).agg(*[F.avg(c).alias(c) for c in cols])
    return g.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("_n") >= least).drop("_n")


def pchip(t: np.ndarray, v: np.ndarray, at_: np.ndarray) -> np.ndarray:
    """Monotone cubic Hermite interpolation with harmonic-mean slopes and one-sided three-point ends."""
    h, d = np.diff(t), np.diff(v) / np.diff(t)
    if len(t) == 2:
        m = np.array([d[0], d[0]])
    else:
        w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            inner = np.where(d[:-1] * d[1:] > 0, (w1 + w2) / (w1 / d[:-1] + w2 / d[1:]), 0.0)

        def end(h0, h1, d0, d1):
            s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
            if np.sign(s) != np.sign(d0):
                return 0.0
            return 3 * d0 if np.sign(d0) != np.sign(d1) and abs(s) > 3 * abs(d0) else s

        m = np.concatenate(([end(h[0], h[1], d[0], d[1])], inner, [end(h[-1], h[-2], d[-1], d[-2])]))
    k = np.clip(np.searchsorted(t, at_, side="right") - 1, 0, len(h) - 1)
    u = (at_ - t[k]) / h[k]
    return v[k] * (1 + 2 * u) * (1 - u) ** 2 + h[k] * m[k] * u * (1 - u) ** 2 + v[k + 1] * u * u * (3 - 2 * u) + h[k] * m[k + 1] * u * u * (u - 1)


def pchip_tracks(tracks: DataFrame, cols: Sequence[str], domain: str, n: int) -> DataFrame:
    """Arrays of ``n`` points along the domain by ``pchip``; tracks of fewer than 3 points become empty."""
    fields = tracks.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in b.index:
                t, first = np.unique(np.asarray(b.at[i, domain], float), return_index=True)
                grid = np.linspace(t[0], t[-1], n) if len(t) >= 3 else np.zeros(0)
                for c in cols:
                    v = np.asarray(b.at[i, c], float)[first]
                    b.at[i, c] = pchip(t, v, grid).tolist() if len(t) >= 3 else []
                b.at[i, domain] = grid.tolist()
            yield b

    return tracks.withColumns({c: F.col(c).cast("array<double>") for c in [*cols, domain]}).mapInPandas(run, _doubles(fields, [*cols, domain]))


def _doubles(schema, cols: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {'array<double>' if f.name in cols else f.dataType.simpleString()}" for f in schema.fields)


def simplify_mask(p: np.ndarray, eps: float) -> np.ndarray:
    """Ramer-Douglas-Peucker: which points stay. Distance to the clamped segment, strictly over ``eps``, first of the farthest."""
    keep = np.zeros(len(p), bool)
    keep[[0, -1]] = True
    stack = [(0, len(p) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        seg, rel = p[b] - p[a], p[a + 1 : b] - p[a]
        square = seg @ seg
        u = np.clip(rel @ seg / square, 0, 1) if square > 0 else np.zeros(len(rel))
        d = np.linalg.norm(rel - u[:, None] * seg, axis=1)
        k = int(d.argmax())
        if d[k] > eps:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    # A point that shares the coordinates of one that stays stays as well.
    kept = {tuple(q) for q in p[keep].tolist()}
    return np.array([tuple(q) in kept for q in p.tolist()])


def simplify_tracks(tracks: DataFrame, x: str, y: str, eps: float, also: Sequence[str] = ()) -> DataFrame:
    """Tracks reduced to the points that ``simplify_mask`` keeps, in every listed array; ``n`` follows."""
    cols = [x, y, *also]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in b.index:
                p = np.column_stack([np.asarray(b.at[i, x], float), np.asarray(b.at[i, y], float)])
                if len(p) > 2:
                    m = simplify_mask(p, eps)
                    for c in cols:
                        b.at[i, c] = np.asarray(b.at[i, c], float)[m].tolist()
                    if "n" in b:
                        b.at[i, "n"] = int(m.sum())
            yield b

    return tracks.withColumns({c: F.col(c).cast("array<double>") for c in cols}).mapInPandas(run, _doubles(tracks.schema, cols))
