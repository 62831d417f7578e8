"""Feature vectors of tracks: building, filling, scaling, principal axes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import at, let


def matrix(points: DataFrame, keys: Sequence[str], unit: str, cols: Sequence[str], step: str = "step", n_points: int | None = None) -> DataFrame:
    """One row a unit: its points in order, interleaved into one array ``v``. With ``n_points`` only units with all steps 0..n-1."""
    if {"latitude", "longitude"} & set(cols):
        raise ValueError("features are metric: take projected columns, not degrees")
    p = F.array_sort(F.collect_list(F.struct(step, *cols)))
    g = points.groupBy(*keys, unit).agg(p.alias("_p"), F.countDistinct(step).alias("_n"), F.min(step).alias("_a"), F.max(step).alias("_z"))
    if n_points:
        g = g.where((F.size("_p") == n_points) & (F.col("_n") == n_points) & (F.col("_a") == 0) & (F.col("_z") == n_points - 1))
    return g.select(*keys, unit, F.flatten(F.transform("_p", lambda q: F.array(*[q[c].cast("double") for c in cols]))).alias("v"))


def fill_gaps(a: Column) -> Column:
    """Nulls and NaNs between known values by linear interpolation over the index, beyond them by the nearest.

    In one walk: each known value gives the stretch up to the next one.
    """

    def stretches(known: Column) -> Column:
        n = F.size(known)
        first, last = F.get(known, F.lit(0)), F.get(known, n - 1)

        def stretch(p: Column, q: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), q["i"] - p["i"] - 1), lambda k: F.when(k == 0, p["x"]).otherwise(p["x"] + (q["x"] - p["x"]) * k / (q["i"] - p["i"])))

        inner = F.flatten(F.zip_with(F.slice(known, 1, F.greatest(n - 1, F.lit(0))), F.slice(known, 2, F.greatest(n - 1, F.lit(0))), stretch))
        filled = F.concat(F.array_repeat(first["x"], first["i"]), inner, F.array_repeat(last["x"], last["n"] - last["i"]))
        return F.when(n > 0, filled)

    def known(a: Column) -> Column:
        return F.filter(F.transform(a, lambda x, i: F.struct(i.alias("i"), x.cast("double").alias("x"), F.size(a).alias("n"))), lambda p: p["x"].isNotNull() & ~F.isnan(p["x"]))

    return let(let(a, known), stretches)


def _long(df: DataFrame, keys: Sequence[str], unit: str, v: str) -> DataFrame:
    return df.select(*keys, unit, F.posexplode(F.col(v).cast("array<double>")).alias("dim", "x"))


def _wide(df: DataFrame, keys: Sequence[str], unit: str, v: str) -> DataFrame:
    return df.groupBy(*keys, unit).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias(v))


def impute(df: DataFrame, keys: Sequence[str], unit: str, v: str = "v", how: str = "mean") -> DataFrame:
    """Missing values become the mean or median of their dimension in the flow, or 0 where all are missing."""
    long = _long(df, keys, unit, v).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    f = F.avg("x") if how == "mean" else F.median("x")
    stat = long.groupBy(*keys, "dim").agg(f.alias("m"))
    return _wide(long.join(stat, [*keys, "dim"]).withColumn("x", F.coalesce("x", "m", F.lit(0.0))), keys, unit, v)


def standardise(df: DataFrame, keys: Sequence[str], unit: str, v: str = "v") -> DataFrame:
    """Zero mean and unit population deviation of each dimension; constant ones are only centred."""
    long = _long(df, keys, unit, v)
    stat = long.groupBy(*keys, "dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return _wide(long.join(stat, [*keys, "dim"]).withColumn("x", (F.col("x") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)), keys, unit, v)


def principal_axes(df: DataFrame, v: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, axes, explained shares): the covariance is summed by the executors, its eigenvectors are found on the driver.

    A partition gives one matrix of products, and the driver gets dims x dims numbers. An axis points where its largest loading is positive. Runs a job.
    """
    dims = df.select(F.max(F.size(v))).first()[0] or 0
    x = df.where(F.col(v).isNotNull()).select(F.col(v).cast("array<double>").alias("v"))
    means = x.select(F.posexplode("v").alias("i", "a")).groupBy("i").agg(F.avg("a").alias("m")).collect()  # one row a dimension
    mean = np.zeros(dims)
    for r in means:
        mean[r["i"]] = r["m"]

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((dims, dims)), 0
        for batch in batches:
            if len(batch):
                c = np.array(batch["v"].tolist(), float) - mean  # centred first: sums of products then lose nothing
                total, n = total + c.T @ c, n + len(c)
        if n:
            i, j = np.triu_indices(dims)
            yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "s": total[i, j], "n": n})

    cov = np.zeros((dims, dims))
    for r in x.mapInPandas(products, "i int, j int, s double, n long").groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["s"] / r["n"]
    w, e = np.linalg.eigh(cov)
    w, e = np.maximum(w[::-1], 0), e[:, ::-1]
    e = e * np.sign(e[np.abs(e).argmax(0), np.arange(dims)])
    return mean, e[:, :k], w[:k] / w.sum() if w.sum() > 0 else w[:k]


def project(df: DataFrame, v: str, mean: np.ndarray, axes: np.ndarray, name: str = "pc") -> DataFrame:
    """Coordinates on the axes as an array, by expressions."""
    def dot(k: int) -> Column:
        w = F.array(*[F.lit(float(x)) for x in axes[:, k]])
        return F.aggregate(F.zip_with(F.col(v).cast("array<double>"), w, lambda a, b: a * b), F.lit(-float(mean @ axes[:, k])), lambda s, z: s + z)

    return df.withColumn(name, F.array(*[dot(k) for k in range(axes.shape[1])]))


def embed(v: Column, dims: int = 2, points: int = 16) -> Column:
    """A track for neighbour search: its points resampled by index to ``points``, interleaved."""
    from ..functions.arrays import by_index

    n = (F.size(v) / dims).cast("int")
    axis = lambda d: F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(v, i * dims + d))
    axes = [by_index(axis(d), points) for d in range(dims)]
    return F.flatten(F.transform(F.arrays_zip(*[a.alias(f"a{d}") for d, a in enumerate(axes)]), lambda z: F.array(*[z[f"a{d}"] for d in range(dims)])))


def group_flights(points: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], least: int = 3) -> DataFrame:
    """Points of each identity and day as one array of structs, if there are at least ``least``."""
    day = F.to_date(ts).alias("day")
    g = points.where(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys, day).agg(F.array_sort(F.collect_list(F.struct(ts, *cols))).alias("points"))
    return g.where(F.size("points") >= least)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, with their place."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
