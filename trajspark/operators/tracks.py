"""Backbones, side tracks and what a noise model is fed with and gives back."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import to_db, to_energy

# Side tracks, as (name, multiple of the lateral deviation, share of the flights).
TRACKS = (
    ("centre", 0.0, 0.28),
    ("left_1", 0.71, 0.22),
    ("right_1", -0.71, 0.22),
    ("left_2", 1.43, 0.11),
    ("right_2", -1.43, 0.11),
    ("left_3", 2.14, 0.03),
    ("right_3", -2.14, 0.03),
)


def backbones(points: DataFrame, keys: Sequence[str], unit: str, cols: Sequence[str], percentiles: Sequence[int] = (10, 50, 90), step: str = "step", cluster: str | None = None, min_flights: int = 1) -> DataFrame:
    """Exact percentiles of each column at each step, one row a percentile; noise and small clusters are skipped."""
    p = points.where(F.col(cluster) >= 0) if cluster else points
    by = [*keys, *([cluster] if cluster else [])]
    sizes = p.groupBy(*by).agg(F.countDistinct(unit).alias("n_flights")).where(F.col("n_flights") >= min_flights)
    q = F.array(*[F.lit(x / 100) for x in percentiles])
    wide = p.groupBy(*by, step).agg(*[F.percentile(c, q).alias(c) for c in cols])
    each = F.arrays_zip(F.array(*[F.lit(x) for x in percentiles]).alias("percentile"), *[F.col(c) for c in cols])
    rows = wide.select(*by, step, F.explode(each).alias("_z")).select(*by, step, F.col("_z.percentile").alias("percentile"), *[F.col(f"_z.{c}").alias(c) for c in cols])
    return rows.join(sizes, by)


def tangents(line: DataFrame, keys: Sequence[str], x: str, y: str, step: str = "step") -> DataFrame:
    """Adds unit tangents (tx, ty) by central differences, one-sided at the ends, and normals (nx, ny)."""
    w = Window.partitionBy(*keys).orderBy(step)
    dx = F.coalesce(F.lead(x).over(w), F.col(x)) - F.coalesce(F.lag(x).over(w), F.col(x))
    dy = F.coalesce(F.lead(y).over(w), F.col(y)) - F.coalesce(F.lag(y).over(w), F.col(y))
    d = line.withColumns({"_dx": dx, "_dy": dy})
    norm = F.hypot("_dx", "_dy")
    norm = F.when(norm == 0, 1.0).otherwise(norm)
    d = d.withColumns({"tx": F.col("_dx") / norm, "ty": F.col("_dy") / norm}).drop("_dx", "_dy")
    return d.withColumns({"nx": -F.col("ty"), "ny": F.col("tx")})


def lateral_offsets(points: DataFrame, line: DataFrame, keys: Sequence[str], x: str, y: str, step: str = "step") -> DataFrame:
    """Points with ``offset``, their signed distance from the line at their step, along its normal."""
    l = tangents(line, keys, x, y, step).select(*keys, step, F.col(x).alias("_x"), F.col(y).alias("_y"), "nx", "ny")
    j = points.join(l, [*keys, step])
    return j.withColumn("offset", (F.col(x) - F.col("_x")) * F.col("nx") + (F.col(y) - F.col("_y")) * F.col("ny")).drop("_x", "_y", "nx", "ny")


def side_tracks(points: DataFrame, keys: Sequence[str], x: str, y: str, step: str = "step", tracks=TRACKS) -> DataFrame:
    """The seven tracks of each flow: its median line moved along the normals by multiples of the sample deviation of all offsets."""
    line = points.groupBy(*keys, step).agg(F.median(x).alias(x), F.median(y).alias(y))
    sigma = lateral_offsets(points, line, keys, x, y, step).groupBy(*keys).agg(F.stddev_samp("offset").alias("sigma"))
    t = F.explode(F.array(*[F.struct(F.lit(n).alias("track"), F.lit(k).alias("k"), F.lit(w).alias("weight")) for n, k, w in tracks]))
    d = tangents(line, keys, x, y, step).join(sigma, list(keys)).withColumn("_t", t)
    shift = F.col("_t.k") * F.coalesce("sigma", F.lit(0.0))
    return d.select(*keys, step, "_t.track", "_t.weight", (F.col(x) + shift * F.col("nx")).alias(x), (F.col(y) + shift * F.col("ny")).alias(y))


def track_counts(flows: DataFrame, keys: Sequence[str], total: str, tracks=TRACKS) -> DataFrame:
    """Flights of each track: total x weight rounded half to even, what is left goes to the centre, never below 0."""
    each = [F.bround(F.col(total) * F.lit(w), 0).cast("long") for _, _, w in tracks]
    rest = F.col(total) - sum(each[1:], each[0])
    rows = F.array(*[F.struct(F.lit(n).alias("track"), F.greatest(c + (rest if i == 0 else 0), F.lit(0)).cast("long").alias("n_flights")) for i, ((n, _, _), c) in enumerate(zip(tracks, each, strict=True))])
    return flows.select(*keys, F.inline(rows))


def dominant(labels: DataFrame, keys: Sequence[str], cluster: str) -> DataFrame:
    """The cluster with most rows of each group; ties to the smaller."""
    n = labels.where(F.col(cluster) >= 0).groupBy(*keys, cluster).agg(F.count(F.lit(1)).alias("n_rows"))
    return n.groupBy(*keys).agg(F.max_by(cluster, F.struct("n_rows", -F.col(cluster))).alias(cluster), F.max("n_rows").alias("n_rows"))


def turns(line: DataFrame, keys: Sequence[str], x: str, y: str, step: str = "step") -> DataFrame:
    """Adds ``radius`` of the circle through each point and its neighbours (abc / 4K; null when straight) and ``turn``: l, r or s."""
    w = Window.partitionBy(*keys).orderBy(step)
    p = {f"_{n}{k}": f(c).over(w) for n, f in (("p", F.lag), ("n", F.lead)) for k, c in (("x", x), ("y", y))}
    d = line.withColumns(p)
    ux, uy = F.col(x) - F.col("_px"), F.col(y) - F.col("_py")
    vx, vy = F.col("_nx") - F.col(x), F.col("_ny") - F.col(y)
    d = d.withColumn("_cross", ux * vy - uy * vx)
    sides = F.hypot(ux, uy) * F.hypot(vx, vy) * F.hypot(F.col("_nx") - F.col("_px"), F.col("_ny") - F.col("_py"))
    d = d.withColumn("radius", F.when(F.col("_cross") != 0, sides / (2 * F.abs("_cross"))))
    turn = F.when(F.col("_cross") > 0, "l").when(F.col("_cross") < 0, "r").otherwise("s")
    return d.withColumn("turn", turn).drop("_px", "_py", "_nx", "_ny", "_cross")


def spline(t: np.ndarray, v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline with the not-a-knot condition."""
    n = len(t)
    if n < 3:
        return np.interp(at, t, v)
    if n == 3:
        return np.polyval(np.polyfit(t, v, 2), at)
    h, d = np.diff(t), np.diff(v) / np.diff(t)
    m = np.zeros((n, n))
    r = np.zeros(n)
    for i in range(1, n - 1):
        m[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i] = 6 * (d[i] - d[i - 1])
    m[0, :3] = h[1], -(h[0] + h[1]), h[0]
    m[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    c = np.linalg.solve(m, r)
    k = np.clip(np.searchsorted(t, at, side="right") - 1, 0, n - 2)
    a, b = t[k + 1] - at, at - t[k]
    return (c[k] * a**3 + c[k + 1] * b**3) / (6 * h[k]) + (v[k] / h[k] - c[k] * h[k] / 6) * a + (v[k + 1] / h[k] - c[k + 1] * h[k] / 6) * b


def ground_track(x: np.ndarray, y: np.ndarray, start: tuple[float, float] | None = None, spacing: float = 200.0, gap: float = 5.0) -> np.ndarray:
    """(x, y, s) every ``spacing`` metres: the runway's start replaces the first point, gaps over ``gap`` mean legs are filled evenly, then a spline over chainage."""
    p = np.column_stack([x, y]).astype(float)
    if start is not None:
        p = np.vstack([[start], p[1:]])
    p = p[np.concatenate(([True], np.any(np.diff(p, axis=0) != 0, axis=1)))]
    legs = np.hypot(*np.diff(p, axis=0).T)
    if not len(legs):
        return np.column_stack([p, np.zeros(len(p))])
    filled = [p[:1]]
    for a, b, leg in zip(p, p[1:], legs, strict=False):
        k = int(np.ceil(leg / legs.mean())) if leg > gap * legs.mean() else 1
        filled.append(a + (b - a) * (np.arange(1, k + 1) / k)[:, None])
    p = np.vstack(filled)
    s = np.concatenate(([0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))))
    grid = np.append(np.arange(0, s[-1], spacing), s[-1])
    return np.column_stack([spline(s, p[:, 0], grid), spline(s, p[:, 1], grid), grid])


def ground_tracks(lines: DataFrame, keys: Sequence[str], x: str, y: str, step: str = "step", start: tuple[float, float] | None = None, spacing: float = 200.0) -> DataFrame:
    """Every line of a group of keys as a ground track: x, y, chainage s and step."""
    schema = ", ".join(f"`{c}` {t}" for c, t in lines.select(*keys).dtypes) + f", step int, `{x}` double, `{y}` double, s double"

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(step)
        g = ground_track(b[x].to_numpy(float), b[y].to_numpy(float), start, spacing)
        return pd.DataFrame({**dict(zip(keys, key, strict=True)), "step": np.arange(len(g), dtype=np.int32), x: g[:, 0], y: g[:, 1], "s": g[:, 2]})

    return lines.groupBy(*keys).applyInPandas(run, schema)


def experiment_inputs(labels: DataFrame, flow: Sequence[str], cluster: str, type_: str, direction: str, profiles: DataFrame, classes: DataFrame, default: str = "DEFAULT") -> DataFrame:
    """One row for each flow, cluster (noise left out) and aircraft type: flights, height profile, spectral class, and where they came from.

    ``profiles`` (type, direction, profile) is asked for the type, then for ``default``; ``classes`` (type, spectral_class)
    likewise. A type without either is kept, with nulls and source 'none'. Unknown types count as ``default``.
    """
    named = F.coalesce(F.when(F.trim(type_) != "", F.upper(F.trim(type_))), F.lit(default))
    n = labels.where(F.col(cluster) >= 0).groupBy(*flow, cluster, F.col(direction).alias("_d"), named.alias("_t")).agg(F.count(F.lit(1)).alias("n_flights"))

    def asked(rows: DataFrame, table: DataFrame, by: Sequence[str], value: str) -> DataFrame:
        t = table.select(F.upper(F.trim("type")).alias("_type"), *[F.col(c).alias(f"_{c}") for c in by], F.col(value).alias(f"_{value}")).groupBy("_type", *[f"_{c}" for c in by]).agg(F.min(f"_{value}").alias(f"_{value}"))
        same = [F.col("_d") == F.col(f"_{c}") for c in by]
        own = rows.join(t, reduce(lambda a, b: a & b, same, F.col("_t") == F.col("_type")), "left").drop("_type", *[f"_{c}" for c in by]).withColumnRenamed(f"_{value}", "_own")
        other = own.join(t.where(F.col("_type") == default), reduce(lambda a, b: a & b, same, F.lit(True)), "left") if by else own.join(F.broadcast(t.where(F.col("_type") == default)), how="left")  # one row
        source = F.when(F.col("_own").isNotNull(), "type").when(F.col(f"_{value}").isNotNull(), "default").otherwise("none")
        return other.withColumns({value: F.coalesce("_own", f"_{value}"), f"{value}_from": source}).drop("_type", "_own", f"_{value}", *[f"_{c}" for c in by])

    found = asked(asked(n, profiles, ["direction"], "profile"), classes, [], "spectral_class")
    return found.select(*flow, cluster, F.col("_t").alias("aircraft_type"), F.col("_d").alias("direction"), "n_flights", "profile", "profile_from", "spectral_class", "spectral_class_from")


def total_levels(maps: DataFrame, keys: Sequence[str], level: str, scale: Column | float = 1.0) -> DataFrame:
    """Levels in dB summed as energy, whatever number of maps they come from."""
    energy = F.sum(to_energy(F.col(level)) * scale)
    return maps.groupBy(*keys).agg(energy.alias("energy"), to_db(energy).alias("level_db"))


def compare_levels(predicted: DataFrame, reference: DataFrame, keys: Sequence[str], level: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute and mean squared error and the worst point of predictions against a reference, by any grouping."""
    j = predicted.join(reference.select(*keys, F.col(level).alias("_ref")), list(keys)).withColumn("delta", F.col(level) - F.col("_ref"))
    err = F.abs("delta")
    return j.groupBy(*by).agg(F.count(F.lit(1)).alias("n_points"), F.avg(err).alias("mae"), F.avg(F.col("delta") ** 2).alias("mse"), F.max(err).alias("max_abs"), F.max_by(F.col(keys[0]), F.struct(err, F.col(keys[0]))).alias("hotspot"))
