"""Smoothing and derivatives along ordered points, as window expressions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let


def rolling(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], width: int, how: str = "mean", suffix: str = "") -> DataFrame:
    """Centred mean or median of ``width`` rows, fewer at the ends; an even window reaches further back."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(width // 2), (width - 1) // 2)
    if how == "mean":
        return df.withColumns({c + suffix: F.avg(c).over(w) for c in cols})
    # A median takes no frame: the frame's few values are sorted instead.
    d = df.withColumns({f"_f_{c}": F.sort_array(F.collect_list(c).over(w)) for c in cols})
    middle = lambda a: (F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2
    return d.withColumns({c + suffix: middle(F.col(f"_f_{c}")) for c in cols}).drop(*[f"_f_{c}" for c in cols])


def ewm(a: Column, span: int, chunk: int = 64) -> Column:
    """Exponentially weighted array, unadjusted: y0 = x0, y = (1 - k) y + k x with k = 2 / (max(span, 2) + 1).

    Walked in chunks, as every step of a fold copies what it has gathered: a step copies its chunk, and only
    the end of a chunk the list of chunks.
    """
    k = 2.0 / (max(span, 2) + 1)

    def walk(a: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return let(F.coalesce((1 - k) * acc["last"] + k * x, x), lambda y: F.struct(F.concat(acc["out"], F.array(y)).alias("out"), y.alias("last")))

        def part(acc: Column, c: Column) -> Column:
            start = F.struct(F.array().cast("array<double>").alias("out"), acc["last"].alias("last"))
            done = F.aggregate(F.slice(a, c * chunk + 1, F.lit(chunk)), start, step)
            return let(done, lambda d: F.struct(F.concat(acc["out"], F.array(d["out"])).alias("out"), d["last"].alias("last")))

        none = F.struct(F.array().cast("array<array<double>>").alias("out"), F.lit(None).cast("double").alias("last"))
        chunks = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.floor((F.size(a) - 1) / chunk).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.when(a.isNotNull(), F.flatten(F.aggregate(chunks, none, part, lambda acc: acc["out"])))

    return let(a, walk)


def savgol_rows(width: int, degree: int) -> np.ndarray:
    """Row r: coefficients over a full window for its r-th place, by least squares."""
    t = np.arange(width) - (width - 1) / 2
    v = np.vander(t, degree + 1, increasing=True)
    return v @ np.linalg.pinv(v)


def savgol(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], width: int = 7, degree: int = 2, suffix: str = "") -> DataFrame:
    """Savitzky-Golay: inner points by their centred window, the ends by the polynomial of the first and last whole window.

    An even width grows by one. A track shorter than that, or a width below 3, is left as it is.
    """
    if width < 3:
        return df.withColumns({c + suffix: F.col(c) for c in cols}) if suffix else df
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = Window.partitionBy(*keys)
    odd = width + 1 - width % 2
    degree = min(degree, odd - 1)
    m, rows = odd // 2, savgol_rows(odd, degree)
    d = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(whole)})

    def value(c: str) -> Column:
        inner = sum((float(rows[m, k]) * F.lag(c, m - k).over(w) for k in range(odd)), F.lit(0.0))
        out = F.when((F.col("_i") >= m) & (F.col("_i") < F.col("_n") - m), inner)
        for r in range(m):
            head = sum((float(rows[r, k]) * F.lag(c, r - k).over(w) for k in range(odd)), F.lit(0.0))
            tail = sum((float(rows[odd - 1 - r, k]) * F.lag(c, odd - 1 - r - k).over(w) for k in range(odd)), F.lit(0.0))
            out = out.when(F.col("_i") == r, head).when(F.col("_i") == F.col("_n") - 1 - r, tail)
        return F.when(F.col("_n") < odd, F.col(c)).otherwise(out)

    return d.withColumns({c + suffix: value(c) for c in cols}).drop("_i", "_n")


def rolling_outliers(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, width: int = 5, spread: float = 3.0, keep_edges: bool = True) -> DataFrame:
    """Adds ``inlier``: within mean +- spread * sample deviation of a whole centred window; rows without one are edges."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(width // 2), (width - 1) // 2)
    mean, dev, n = F.avg(col).over(w), F.stddev_samp(col).over(w), F.count(col).over(w)
    return df.withColumn("inlier", F.when(n == width, F.abs(F.col(col) - mean) <= spread * dev).otherwise(F.lit(keep_edges)))


def chainage(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, y: str, name: str = "s") -> DataFrame:
    """Adds ``seg`` (length from the point before, 0 at the first) and the running ``name``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    seg = F.coalesce(F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)), F.lit(0.0))
    return df.withColumn("seg", seg).withColumn(name, F.sum("seg").over(w))


def speeds(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, y: str, t: str, per_s: float = 1.0) -> DataFrame:
    """Adds ``speed`` at points: mean of the legs on both sides, the one leg at the ends; legs without time are left out.

    ``t`` counts ``per_s`` to a second. Whole microseconds are subtracted before they become seconds, which as
    doubles since 1970 hold no more than a quarter of one.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    dt = (F.col(t) - F.lag(t).over(w)) / F.lit(per_s)
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    d = df.withColumn("_leg", F.when(dt > 0, F.sqrt(dx * dx + dy * dy) / dt))
    after = F.lead("_leg").over(w)
    both = F.array_compact(F.array(F.col("_leg"), after))
    return d.withColumn("speed", F.when(F.size(both) > 0, F.aggregate(both, F.lit(0.0), lambda s, v: s + v) / F.size(both))).drop("_leg")
