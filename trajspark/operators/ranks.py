"""Ordered work on groups of any size, by slices: no task ever sorts or walks a whole group.

Rows are range-partitioned by (keys, order) and written down with the number of their slice. What a
slice needs to know of those before it (how many rows, the last ones, a running state) is one small
row a slice, and the walk over a group's slices is all that one task does for the group.

Defined results. Null keys are groups like any other; null values sort first. Rows equal in keys and
order are in the same slice, and are numbered in any order among themselves.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut

SLICE = "_slice"


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: int | None = None) -> DataFrame:
    """``df``, written down, with the number of each row's slice. Runs a job."""
    by = [F.col(c) for c in [*keys, *order]]
    ranged = df.repartitionByRange(slices, *by) if slices else df.repartitionByRange(*by)
    return cut(ranged.withColumn(SLICE, F.spark_partition_id()))


def beside(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the other columns of ``small``, one row for each combination of ``keys``, null keys too."""
    renamed = small.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    if not keys:
        return df.crossJoin(F.broadcast(renamed))  # one row
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return df.join(renamed, on, "left").drop(*[f"_of_{k}" for k in keys])


def before(d: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """(keys, slice, values): sums of aggregates over the earlier slices of each group, 0 for the first."""
    per = d.groupBy(*keys, SLICE).agg(*[c.alias(n) for n, c in values.items()])
    w = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*keys, SLICE, *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in values])


def ranked_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank", slices: int | None = None) -> DataFrame:
    """Exact row numbers from 1 within ``keys``, by ``order``."""
    d = sliced(df, keys, order, slices)
    local = F.row_number().over(Window.partitionBy(*keys, SLICE).orderBy(*order))
    counted = beside(d.withColumn("_local", local), before(d, keys, {"_before": F.count(F.lit(1))}), [*keys, SLICE])
    return counted.withColumn(name, (F.col("_local") + F.col("_before")).cast("long")).drop("_local", "_before", SLICE)


def counted_values(df: DataFrame, keys: Sequence[str], col: str, slices: int | None = None) -> DataFrame:
    """(keys, col, n, less, total): how often each distinct known value occurs, and how many of the group's values are less."""
    g = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("n"))
    d = sliced(g, keys, [col], slices)
    inner = Window.partitionBy(*keys, SLICE).orderBy(col).rowsBetween(Window.unboundedPreceding, -1)
    local = d.withColumn("_local", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    out = beside(local, before(d, keys, {"_before": F.sum("n")}), [*keys, SLICE])
    total = d.groupBy(*keys).agg(F.sum("n").alias("total"))
    return beside(out.withColumn("less", F.col("_local") + F.col("_before")).drop("_local", "_before", SLICE), total, keys)


def average_ranks(df: DataFrame, keys: Sequence[str], col: str, name: str) -> DataFrame:
    """``df`` with the average rank, from 1, of a known value within its group."""
    ranks = counted_values(df, keys, col).select(*keys, col, (F.col("less") + (F.col("n") + 1) / 2).alias(name))
    return beside(df, ranks, [*keys, col])


def quantiles(df: DataFrame, keys: Sequence[str], col: str, qs: dict[str, float]) -> DataFrame:
    """(keys, a column for each of ``qs``): exact quantiles, linear between the two values they fall between."""
    v = counted_values(df.select(*keys, F.col(col).alias("_x")), keys, "_x")
    at = lambda k: F.max(F.when((F.col("less") <= k) & (k < F.col("less") + F.col("n")), F.col("_x")))
    out = []
    for name, q in qs.items():
        place = (F.col("total") - 1) * F.lit(float(q))
        low, high = at(F.floor(place)), at(F.ceil(place))
        part = F.max(place - F.floor(place))
        out.append(F.when(part == 0, low.cast("double")).otherwise(low * (1 - part) + high * part).alias(name))
    return v.groupBy(*keys).agg(*out)
