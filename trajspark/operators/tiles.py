"""Distances between all units of a group, by square tiles.

The units of a group are dealt into blocks of about ``per_block``, so that a group of any size, one
with a third of all rows too, becomes many bounded tasks: one for each pair of blocks. A tile's
distances come from NumPy; where only some pairs are wanted (the k nearest, those within a radius,
sums by cluster), only these leave the tile, and the table of all pairs never exists.

Defined results. Units of a null group or with a null vector take part in no pair. Vectors of
different lengths have no distance. A unit that occurs twice is not its own neighbour. Ties go to the smaller unit.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from .features import ranked

PER_BLOCK = 1_024
#: Numbers that a step of a tile holds at a time.
_CELLS = 4 << 20


def blocked(df: DataFrame, keys: Sequence[str], unit: str, per_block: int = PER_BLOCK) -> DataFrame:
    """``df`` with ``_block`` and the number of ``_blocks`` of its group: one small row a group is joined."""
    known = df.where(" and ".join(f"`{k}` is not null" for k in keys)) if keys else df
    sizes = known.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / per_block).cast("int").alias("_blocks"))
    sized = known.join(sizes, list(keys)) if keys else known.crossJoin(F.broadcast(sizes))  # one row
    return sized.withColumn("_block", F.pmod(F.xxhash64(F.col(unit)), F.col("_blocks")).cast("int"))


def _both_sides(df: DataFrame, keys: Sequence[str], unit: str, per_block: int) -> tuple[DataFrame, DataFrame]:
    b = blocked(df, keys, unit, per_block)
    rest = [F.col(c).alias(c) for c in b.columns if c not in ("_block", "_blocks")]  # columns of their own on each side
    left = b.select(*rest, F.col("_block").alias("_i"), F.explode(F.sequence(F.col("_block"), F.col("_blocks") - 1)).alias("_j"))
    right = b.select(*rest, F.explode(F.sequence(F.lit(0), F.col("_block"))).alias("_i"), F.col("_block").alias("_j"))
    return left, right


def by_tile(df: DataFrame, keys: Sequence[str], unit: str, cols: Sequence[str], kernel: Callable[[pd.DataFrame, pd.DataFrame, bool], dict[str, np.ndarray]], schema: str, per_block: int = PER_BLOCK) -> DataFrame:
    """Rows that ``kernel`` (left rows, right rows, whether both are the same block) makes of every tile, behind the group's keys."""
    src = df.select(*keys, unit, *cols)
    left, right = _both_sides(src, keys, unit, per_block)
    named = [f"`{k}` {t}" for k, t in src.select(*keys).dtypes]
    names = [p.split()[0].strip("`") for p in schema.split(", ")]

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in [*keys, *names]})
        i, j = key[-2], key[-1]
        out = kernel(a, b, i == j)
        n = len(next(iter(out.values())))
        return pd.DataFrame({**dict(zip(keys, key, strict=False)), **out}, columns=[*keys, *names], index=range(n))

    by = [*keys, "_i", "_j"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(run, ", ".join([*named, schema]))


def _matrix(v: pd.Series) -> np.ndarray:
    return np.array(v.tolist(), float)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows, from differences: exact for equal rows, unlike sums of products."""
    out = np.empty((len(x), len(y)))
    step = max(1, _CELLS // max(1, y.size))
    for a in range(0, len(x), step):
        d = x[a : a + step, None, :] - y[None]
        out[a : a + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def _tiles(df: DataFrame, keys: Sequence[str], unit: str, v: str, more: Sequence[str], kernel: Callable, schema: str, per_block: int) -> DataFrame:
    """``kernel`` (left rows, right rows, same block) over rows whose vectors are equally long."""
    names = [p.split()[0].strip("`") for p in schema.split(", ")]

    def run(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> dict[str, np.ndarray]:
        la, lb = a[v].map(len), b[v].map(len)
        parts = [kernel(a[la == n], b[lb == n], same) for n in sorted(set(la) & set(lb))]
        return {c: np.concatenate([p[c] for p in parts]) for c in names} if parts else {c: np.zeros(0) for c in names}

    known = df.where(F.col(v).isNotNull()).withColumn(v, F.col(v).cast("array<double>"))
    return by_tile(known, keys, unit, [v, *more], run, schema, per_block)


def _pairs_of(a: pd.DataFrame, b: pd.DataFrame, unit: str, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(units of a, units of b, mask of pairs to be taken, mask of pairs to be named the other way round)."""
    ua, ub = a[unit].to_numpy(), b[unit].to_numpy()
    less, more = ua[:, None] < ub[None], ua[:, None] > ub[None]
    return ua, ub, less if same else less | more, more


def pair_distances(df: DataFrame, keys: Sequence[str], unit: str, v: str = "v", within: float | None = None, per_block: int = PER_BLOCK) -> DataFrame:
    """(keys, unit_a < unit_b, d): all pairs of each group, or those ``within`` a distance."""

    def kernel(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> dict[str, np.ndarray]:
        ua, ub, take, turned = _pairs_of(a, b, unit, same)
        d = _distances(_matrix(a[v]), _matrix(b[v]))
        i, j = np.nonzero(take if within is None else take & (d <= within))
        swap = turned[i, j]
        return {f"{unit}_a": np.where(swap, ub[j], ua[i]), f"{unit}_b": np.where(swap, ua[i], ub[j]), "d": d[i, j]}

    kind = dict(df.dtypes)[unit]
    return _tiles(df, keys, unit, v, [], kernel, f"`{unit}_a` {kind}, `{unit}_b` {kind}, `d` double", per_block)


#: Of a distance's 64 bits, those beyond its bin: a bin is 2^-12 of an octave wide.
_BIN = 40


def pair_scales(df: DataFrame, keys: Sequence[str], unit: str, v: str = "v", per_block: int = PER_BLOCK) -> DataFrame:
    """(keys, n, mean, median) of the distances of all pairs of each group, exactly, in two walks over the tiles.

    The first leaves how many distances fall into each bin of their leading bits, the second the distances of
    the bins that hold the middle. Runs jobs.
    """

    def measured(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> tuple[np.ndarray, np.ndarray]:
        take = _pairs_of(a, b, unit, same)[2]
        d = _distances(_matrix(a[v]), _matrix(b[v]))[take]
        d[np.isnan(d)] = np.nan  # of one sign, so that bits are ordered like values
        return d, d.view(np.int64) >> _BIN

    def count(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> dict[str, np.ndarray]:
        d, at = measured(a, b, same)
        bins, at, n = np.unique(at, return_inverse=True, return_counts=True)
        return {"bin": bins, "n": n, "sum": np.bincount(at, d, len(bins))}

    def middle(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> dict[str, np.ndarray]:
        if not len(a) or not len(b):
            return {"d": np.zeros(0)}
        d, at = measured(a, b, same)
        return {"d": d[(at >= a["_first"].iloc[0]) & (at <= a["_last"].iloc[0])]}

    by = list(keys)
    bins = cut(_tiles(df, keys, unit, v, [], count, "`bin` long, `n` long, `sum` double", per_block).groupBy(*by, "bin").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum")))
    before = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    total = bins.groupBy(*by).agg(F.sum("n").alias("total"), (F.sum("sum") / F.sum("n")).alias("mean"))
    low, high = F.floor((F.col("total") - 1) / 2), F.ceil((F.col("total") - 1) / 2)
    holds = lambda k: (F.col("less") <= k) & (k < F.col("less") + F.col("n"))
    placed = bins.withColumn("less", F.coalesce(F.sum("n").over(before), F.lit(0))).join(total, by)
    ends = cut(placed.groupBy(*by, "total", "mean").agg(F.min(F.when(holds(low), F.col("bin"))).alias("_first"), F.max(F.when(holds(high), F.col("bin"))).alias("_last"), F.min(F.when(holds(low), F.col("less"))).alias("_less")))
    near = _tiles(df.join(ends.select(*by, "_first", "_last"), by), keys, unit, v, ["_first", "_last"], middle, "`d` double", per_block)
    values = near.groupBy(*by, "d").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy(*by).orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    ordered = values.join(ends, by).withColumn("less", F.coalesce(F.sum("n").over(ahead), F.lit(0)) + F.col("_less"))
    median = (F.max(F.when(holds(low), F.col("d"))) + F.max(F.when(holds(high), F.col("d")))) / 2
    return ordered.groupBy(*by, F.col("total").alias("n"), "mean").agg(median.alias("median"))


def pair_values(df: DataFrame, keys: Sequence[str], unit: str, measure: Callable[[np.ndarray, np.ndarray], np.ndarray], v: str = "v", name: str = "d", symmetric: bool = True, step: int = 4_096, per_block: int = 512, crossed: bool = False) -> DataFrame:
    """(keys, unit_a < unit_b, ``name``): ``measure`` (rows of a, rows of b) of all pairs of equally long vectors, ``step`` pairs at a time.

    The vector of the smaller unit comes first, which counts where the measure is not ``symmetric``. A symmetric measure that is
    ``crossed`` gets (rows of a, 1, values) and (1, rows of b, values) and gives the matrix of each with each.
    """
    if crossed and not symmetric:
        raise ValueError("only a symmetric measure can be crossed")

    def table(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> dict[str, np.ndarray]:
        if same:  # in order, so that its pairs are those above the diagonal
            a, b = a.sort_values(unit), b.sort_values(unit)
        ua, ub, take, turned = _pairs_of(a, b, unit, same)
        x, y = _matrix(a[v]), _matrix(b[v])
        d, rows = np.empty(take.shape), max(1, step // 64)
        for k in range(0, len(x), rows):
            at = slice(k if same else 0, None)
            d[k : k + rows, at] = measure(x[k : k + rows, None], y[None, at])
        i, j = np.nonzero(take)
        swap = turned[i, j]
        return {f"{unit}_a": np.where(swap, ub[j], ua[i]), f"{unit}_b": np.where(swap, ua[i], ub[j]), name: d[i, j]}

    def kernel(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> dict[str, np.ndarray]:
        ua, ub, take, turned = _pairs_of(a, b, unit, same)
        x, y = _matrix(a[v]), _matrix(b[v])
        i, j = np.nonzero(take)
        swap, out = turned[i, j], np.empty(len(i))
        for k in range(0, len(i), step):
            p, q, t = x[i[k : k + step]], y[j[k : k + step]], swap[k : k + step, None]
            out[k : k + step] = measure(p, q) if symmetric else measure(np.where(t, q, p), np.where(t, p, q))
        return {f"{unit}_a": np.where(swap, ub[j], ua[i]), f"{unit}_b": np.where(swap, ua[i], ub[j]), name: out}

    kind = dict(df.dtypes)[unit]
    return _tiles(df, keys, unit, v, [], table if crossed else kernel, f"`{unit}_a` {kind}, `{unit}_b` {kind}, `{name}` double", per_block)


def nearest(df: DataFrame, keys: Sequence[str], unit: str, k: int, v: str = "v", per_block: int = PER_BLOCK) -> DataFrame:
    """(keys, u, v, d, k): each unit's ``k`` nearest in its group, from 1. A tile gives at most k for each of its units."""

    def best(d: np.ndarray, own: np.ndarray, other: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.where(ok, d, np.inf)
        order = np.argsort(other, kind="stable")  # ties to the smaller unit
        d = d[:, order]
        n = min(k, d.shape[1])
        if n < d.shape[1]:
            # The n-th least distance, and all that are no farther; a stable sort of these keeps the smaller units.
            least = np.partition(d, n - 1, axis=1)[:, n - 1 : n]
            i, j = np.nonzero((d <= least) & (d < np.inf))
        else:
            i, j = np.nonzero(d < np.inf)
        at = np.lexsort((j, d[i, j], i))
        i, j = i[at], j[at]
        first = np.searchsorted(i, i, side="left")
        keep = np.arange(len(i)) - first < k
        return i[keep], order[j[keep]]

    def kernel(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> dict[str, np.ndarray]:
        ua, ub = a[unit].to_numpy(), b[unit].to_numpy()
        d, ok = _distances(_matrix(a[v]), _matrix(b[v])), ua[:, None] != ub[None]
        i, j = best(d, ua, ub, ok)
        out = [(ua[i], ub[j], d[i, j])]
        if not same:
            j, i = best(d.T, ub, ua, ok.T)
            out.append((ub[j], ua[i], d[i, j]))
        return dict(zip(("u", "v", "d"), (np.concatenate(x) for x in zip(*out, strict=True)), strict=True))

    kind = dict(df.dtypes)[unit]
    found = _tiles(df, keys, unit, v, [], kernel, f"`u` {kind}, `v` {kind}, `d` double", per_block)
    return ranked(found, [*keys, "u"], ["d", "v"], k, "k")


def nearest_edges(df: DataFrame, keys: Sequence[str], unit: str, k: int, v: str = "v", per_block: int = PER_BLOCK) -> DataFrame:
    """Undirected edges (keys, unit_a < unit_b, d) to each unit's ``k`` nearest."""
    near = nearest(df, keys, unit, k, v, per_block)
    return near.select(*keys, F.least("u", "v").alias(f"{unit}_a"), F.greatest("u", "v").alias(f"{unit}_b"), "d").distinct()


def label_sums(df: DataFrame, keys: Sequence[str], unit: str, label: str, v: str = "v", per_block: int = PER_BLOCK) -> DataFrame:
    """(keys, unit, own label, other label, sum, n): sums of a unit's distances to the units of every label, but for itself."""

    def half(ua: np.ndarray, la: np.ndarray, lb: np.ndarray, d: np.ndarray, ok: np.ndarray) -> list[np.ndarray]:
        found, at = np.unique(lb, return_inverse=True)
        hot = np.eye(len(found))[at]
        total, n = np.where(ok, d, 0.0) @ hot, ok @ hot
        i, k = np.nonzero(n)
        return [ua[i], la[i], found[k], total[i, k], n[i, k].astype(np.int64)]

    def kernel(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> dict[str, np.ndarray]:
        ua, ub, la, lb = a[unit].to_numpy(), b[unit].to_numpy(), a[label].to_numpy(), b[label].to_numpy()
        d, ok = _distances(_matrix(a[v]), _matrix(b[v])), ua[:, None] != ub[None]
        parts = [half(ua, la, lb, d, ok)] + ([] if same else [half(ub, lb, la, d.T, ok.T)])
        return dict(zip(("u", "la", "lb", "sum", "n"), (np.concatenate(x) for x in zip(*parts, strict=True)), strict=True))

    kinds = dict(df.dtypes)
    schema = f"`u` {kinds[unit]}, `la` {kinds[label]}, `lb` {kinds[label]}, `sum` double, `n` long"
    found = _tiles(df, keys, unit, v, [label], kernel, schema, per_block)
    return found.groupBy(*keys, F.col("u").alias(unit), "la", "lb").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"))
