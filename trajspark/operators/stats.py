"""Profiles, counts, ranks, correlations: exact aggregates over any grouping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions.timeops import micros
from . import ranks


def counts(df: DataFrame, keys: Sequence[str], unit: str | None = None, keep_null: bool = False) -> DataFrame:
    """Rows (and distinct units) of each group with its share in percent; groups with a null key go unless kept."""
    d = df if keep_null else df.where(" and ".join(f"`{k}` is not null" for k in keys))
    n = F.count(F.lit(1)) if unit is None else F.countDistinct(unit)
    g = d.groupBy(*keys).agg(n.alias("n"))
    total = g.agg(F.sum("n").alias("_total"))
    return g.crossJoin(F.broadcast(total)).withColumn("pct", F.round(100 * F.col("n") / F.col("_total"), 3)).drop("_total")


def marginals(df: DataFrame, sets: Sequence[Sequence[str]], unit: str) -> DataFrame:
    """Distinct units by several groupings in one pass, with the set's number as ``grouping``."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    each = F.array(*[F.struct(F.lit(i).alias("grouping"), *[(F.col(c) if c in s else F.lit(None)).cast(df.schema[c].dataType).alias(c) for c in cols]) for i, s in enumerate(sets)])
    rows = df.select(F.col(unit).alias("_u"), F.inline(each))
    return rows.groupBy("grouping", *cols).agg(F.countDistinct("_u").alias("n"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Over rows where both are finite and the weight is positive."""
    ok = value.isNotNull() & ~F.isnan(value) & weight.isNotNull() & (weight > 0)
    return F.sum(F.when(ok, value * weight)) / F.sum(F.when(ok, weight))


def profile(df: DataFrame, keys: Sequence[str], ids: str, ts: str, lat: str, lon: str, alt: str, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Rows, distinct ids, time and space extent, missing shares, altitude quantiles and range violations of each group."""
    n = F.count(F.lit(1))
    out = [n.alias("n_rows"), F.countDistinct(ids).alias("n_ids"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")]
    out += [f(c).alias(f"{p}_{c}") for c in (lat, lon) for p, f in (("min", F.min), ("max", F.max))]
    out += [(100 * F.count_if(F.col(c).isNull()) / n).alias(f"missing_{c}") for c in dict.fromkeys((ids, lat, lon, alt))]
    out += [F.percentile(alt, F.lit(q)).alias(f"p{int(q * 100)}_{alt}") for q in (0.05, 0.5, 0.95)]
    out += [F.count_if((F.col(c) < a) | (F.col(c) > b)).alias(f"odd_{c}") for c, (a, b) in (ranges or {}).items()]
    return df.groupBy(*keys).agg(*out)


def spread(df: DataFrame, keys: Sequence[str], col: str, qs: Sequence[float] = (0.05, 0.5, 0.95)) -> DataFrame:
    """Count, mean, population deviation, extremes and exact quantiles."""
    return df.groupBy(*keys).agg(
        F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"), F.min(col).alias("min"), F.max(col).alias("max"), *[F.percentile(col, F.lit(q)).alias(f"p{round(q * 100)}") for q in qs]
    )


def deltas(df: DataFrame, keys: Sequence[str], ts: str, over_s: Sequence[float] = (5, 30, 120), tie: Sequence[str] = ()) -> DataFrame:
    """Summary of the time between a group's consecutive samples, over all groups."""
    w = Window.partitionBy(*keys).orderBy(ts, *tie)
    d = df.select(((micros(ts) - F.lag(micros(ts)).over(w)) / 1_000_000).alias("d")).where("d >= 0")
    sums = d.agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.max("d").alias("max"), *[(100 * F.count_if(F.col("d") > s) / F.count("d")).alias(f"over_{int(s)}s") for s in over_s])
    found = sums.join(ranks.quantiles(d, [], "d", {f"p{round(q * 100)}": q for q in (0.5, 0.9, 0.99)}), how="left")  # one row each
    return found.select("n", "mean", "p50", "p90", "p99", "max", *[f"over_{int(s)}s" for s in over_s])


def robust_outliers(df: DataFrame, keys: Sequence[str], cols: Sequence[str], k: float = 3.0) -> DataFrame:
    """Adds ``distance`` from the group's median point, ``limit`` = median + k * 1.4826 * MAD, and ``outlier`` (strictly beyond)."""
    centre = df.groupBy(*keys).agg(*[F.median(c).alias(f"_m_{c}") for c in cols])
    square = sum(((F.col(c) - F.col(f"_m_{c}")) ** 2 for c in cols), F.lit(0.0))
    d = df.join(centre, list(keys)).withColumn("distance", F.sqrt(square)).drop(*[f"_m_{c}" for c in cols])
    med = d.groupBy(*keys).agg(F.median("distance").alias("_med"))
    mad = d.join(med, list(keys)).groupBy(*keys).agg(F.first("_med").alias("_med"), F.median(F.abs(F.col("distance") - F.col("_med"))).alias("_mad"))
    j = d.join(mad, list(keys)).withColumn("limit", F.col("_med") + k * 1.4826 * F.col("_mad"))
    return j.withColumn("outlier", F.col("distance") > F.col("limit")).drop("_med", "_mad")


def endpoints(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """First and last value of each column, in order."""
    o = F.struct(*order)
    return df.groupBy(*keys).agg(*[F.min_by(c, o).alias(f"first_{c}") for c in cols], *[F.max_by(c, o).alias(f"last_{c}") for c in cols])


def correlations(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Pearson and Spearman (average ranks) of each group; null with fewer than 3 rows or 2 distinct values."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, F.col(a).alias("_a"), F.col(b).alias("_b"))
    d = cut(d)  # three times read
    d = ranks.average_ranks(ranks.average_ranks(d, keys, "_a", "_ra"), keys, "_b", "_rb")
    ok = (F.count(F.lit(1)) >= 3) & (F.min("_a") < F.max("_a")) & (F.min("_b") < F.max("_b"))
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when(ok, F.corr("_a", "_b")).alias("pearson"), F.when(ok, F.corr("_ra", "_rb")).alias("spearman"))


def z_score(col: str) -> Column:
    """Over the whole table by population deviation; 0 where it is constant. For small tables of results."""
    w = Window.partitionBy()
    s = F.stddev_pop(col).over(w)
    return F.when(s > 0, (F.col(col) - F.avg(col).over(w)) / s).otherwise(0.0)


def composite(df: DataFrame, silhouette: str, davies_bouldin: str, calinski: str, noise: str) -> DataFrame:
    """Adds ``score``: weighted z-scores that rank experiments."""
    return df.withColumn("score", 0.35 * z_score(silhouette) - 0.25 * z_score(davies_bouldin) + 0.25 * z_score(calinski) - 0.15 * z_score(noise))


def histogram(df: DataFrame, keys: Sequence[str], col: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts of equal bins from 0 to bins-1; the last one holds its upper edge; what is outside goes."""
    d = df.where((F.col(col) >= lo) & (F.col(col) <= hi))
    b = F.least(F.floor((F.col(col) - lo) * bins / (hi - lo)), F.lit(bins - 1)).cast("long")
    return d.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def ecdf(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Share of rows up to each distinct value."""
    v = ranks.counted_values(df, keys, col)
    return v.select(*keys, col, ((F.col("less") + F.col("n")) / F.col("total")).alias("share"))


def signature(labels: DataFrame, keys: Sequence[str], cluster: str) -> DataFrame:
    """'0=428 / 1=163 + 2307 noise' of each group."""
    n = labels.groupBy(*keys, cluster).agg(F.count(F.lit(1)).alias("n"))
    named = F.array_sort(F.collect_list(F.when(F.col(cluster) >= 0, F.struct(F.col(cluster).alias("c"), F.col("n").alias("n")))))
    text = F.array_join(F.transform(named, lambda x: F.concat_ws("=", x["c"].cast("string"), x["n"].cast("string"))), " / ")
    noise = F.sum(F.when(F.col(cluster) < 0, F.col("n")))
    return n.groupBy(*keys).agg(F.when(noise.isNotNull(), F.concat(text, F.lit(" + "), noise.cast("string"), F.lit(" noise"))).otherwise(text).alias("signature"))


def units(df: DataFrame, speed: str, altitude: str) -> DataFrame:
    """Units guessed from high quantiles: knots over 350, feet over 20,000."""
    fast, high = ranks.quantiles(df, [], speed, {"_fast": 0.99}), ranks.quantiles(df, [], altitude, {"_high": 0.95})
    return fast.crossJoin(high).select(F.when(F.col("_fast") > 350, "kt").otherwise("m/s").alias("speed_unit"), F.when(F.col("_high") > 20_000, "ft").otherwise("m").alias("altitude_unit"))  # one row each


def points_per_flight(df: DataFrame, flight: str) -> DataFrame:
    """Whether flights have one number of points, and its least, median and most."""
    n = df.groupBy(flight).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.min("n").alias("least"), F.median("n").alias("median"), F.max("n").alias("most"), (F.min("n") == F.max("n")).alias("constant"))


def modal(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """The most common value of each group; ties to the first by name."""
    n = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), col)
    return n.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
