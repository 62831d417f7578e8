"""Scores of a clustering, as aggregates. Label -1 is noise and takes no part, except in noise shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiles
from .ranks import ranked_rows


def silhouette(features: DataFrame, keys: Sequence[str], unit: str, label: str, vector: str = "v") -> DataFrame:
    """Mean silhouette of each group's labelled feature vectors; a unit alone in its cluster scores 0.

    Tiles give every unit's sums of distances to each cluster, never the table of pairs.
    """
    return silhouette_of(tiles.label_sums(features.where(F.col(label) >= 0), keys, unit, label, vector), keys, unit)


def silhouette_of_edges(distances: DataFrame, labels: DataFrame, keys: Sequence[str], unit: str, label: str) -> DataFrame:
    """The same from a table of pairs (unit_a < unit_b, d), precomputed by whatever measure."""
    a, b = f"{unit}_a", f"{unit}_b"
    lab = labels.where(F.col(label) >= 0).select(*keys, unit, label)
    both = distances.select(*keys, a, b, "d").unionByName(distances.select(*keys, F.col(b).alias(a), F.col(a).alias(b), "d"))
    la = lab.select(*keys, F.col(unit).alias(a), F.col(label).alias("la"))
    lb = lab.select(*keys, F.col(unit).alias(b), F.col(label).alias("lb"))
    sums = both.join(la, [*keys, a]).join(lb, [*keys, b]).groupBy(*keys, F.col(a).alias(unit), "la", "lb").agg(F.sum("d").alias("sum"), F.count("d").alias("n"))
    return silhouette_of(sums, keys, unit)


def silhouette_of(sums: DataFrame, keys: Sequence[str], unit: str) -> DataFrame:
    """From (keys, unit, la, lb, sum, n): a unit's distances to the clusters ``lb``, itself of ``la``."""
    per = sums.withColumn("m", F.col("sum") / F.col("n"))
    one = per.groupBy(*keys, unit).agg(F.min(F.when(F.col("la") == F.col("lb"), F.col("m"))).alias("inner"), F.min(F.when(F.col("la") != F.col("lb"), F.col("m"))).alias("outer"))
    s = F.when(F.col("inner").isNull(), 0.0).when(F.greatest("inner", "outer") == 0, 0.0).otherwise((F.col("outer") - F.col("inner")) / F.greatest("inner", "outer"))
    return one.groupBy(*keys).agg(F.avg(F.when(F.col("outer").isNotNull(), s)).alias("silhouette"))


def _long(features: DataFrame, keys: Sequence[str], unit: str, label: str, vector: str) -> DataFrame:
    f = features.where(F.col(label) >= 0)
    return f.select(*keys, unit, label, F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "v"))


def davies_bouldin(features: DataFrame, keys: Sequence[str], unit: str, label: str, vector: str) -> DataFrame:
    """Mean over clusters of the worst (spread_i + spread_j) / distance of centroids."""
    long = _long(features, keys, unit, label, vector)
    centre = long.groupBy(*keys, label, "dim").agg(F.avg("v").alias("c"))
    gap = long.join(centre, [*keys, label, "dim"]).groupBy(*keys, unit, label).agg(F.sqrt(F.sum((F.col("v") - F.col("c")) ** 2)).alias("_gap"))
    spread = gap.groupBy(*keys, label).agg(F.avg("_gap").alias("s"))
    i = centre.select(*keys, F.col(label).alias("li"), "dim", F.col("c").alias("ci"))
    j = centre.select(*keys, F.col(label).alias("lj"), "dim", F.col("c").alias("cj"))
    apart = i.join(j, [*keys, "dim"]).where("li <> lj").groupBy(*keys, "li", "lj").agg(F.sqrt(F.sum((F.col("ci") - F.col("cj")) ** 2)).alias("m"))
    si, sj = spread.select(*keys, F.col(label).alias("li"), F.col("s").alias("si")), spread.select(*keys, F.col(label).alias("lj"), F.col("s").alias("sj"))
    worst = apart.join(si, [*keys, "li"]).join(sj, [*keys, "lj"]).groupBy(*keys, "li").agg(F.max((F.col("si") + F.col("sj")) / F.when(F.col("m") > 0, F.col("m"))).alias("r"))
    return worst.groupBy(*keys).agg(F.avg("r").alias("davies_bouldin"))


def calinski_harabasz(features: DataFrame, keys: Sequence[str], unit: str, label: str, vector: str) -> DataFrame:
    """Between-cluster over within-cluster variance, each by its degrees of freedom."""
    long = _long(features, keys, unit, label, vector)
    by = long.groupBy(*keys, label, "dim").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("c"), F.var_pop("v").alias("q"))
    mean = by.groupBy(*keys, "dim").agg((F.sum(F.col("n") * F.col("c")) / F.sum("n")).alias("_mean"))
    sums = by.join(mean, [*keys, "dim"]).groupBy(*keys).agg(
        F.sum(F.col("n") * (F.col("c") - F.col("_mean")) ** 2).alias("between"), F.sum(F.col("n") * F.col("q")).alias("within"), F.countDistinct(label).alias("k")
    )
    n = features.where(F.col(label) >= 0).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    score = F.col("between") / (F.col("k") - 1) / (F.col("within") / (F.col("n") - F.col("k")))
    return sums.join(n, list(keys)).select(*keys, F.when((F.col("k") > 1) & (F.col("n") > F.col("k")) & (F.col("within") > 0), score).alias("calinski_harabasz")) if keys else sums.crossJoin(F.broadcast(n)).select(F.when((F.col("k") > 1) & (F.col("n") > F.col("k")) & (F.col("within") > 0), score).alias("calinski_harabasz"))


def noise_share(labels: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    noise = F.count_if(F.col(label) < 0)
    n = F.count(F.lit(1))
    clusters = F.countDistinct(F.when(F.col(label) >= 0, F.col(label)))
    return labels.groupBy(*keys).agg(n.alias("n_units"), noise.alias("n_noise"), clusters.alias("n_clusters"), (noise / n).alias("noise_frac"), F.when(clusters < 2, "<2 clusters").alias("reason"))


def adjusted_rand(pairs: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings of the same rows."""
    cell = pairs.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("n"))
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    total = cell.groupBy(*keys).agg(F.sum(two("n")).alias("both"), F.sum("n").alias("n"))
    ra = cell.groupBy(*keys, a).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(two("n")).alias("sa"))
    rb = cell.groupBy(*keys, b).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(two("n")).alias("sb"))
    j = total.join(ra, list(keys)).join(rb, list(keys)) if keys else total.crossJoin(F.broadcast(ra)).crossJoin(F.broadcast(rb))
    expected = F.col("sa") * F.col("sb") / two("n")
    top = (F.col("sa") + F.col("sb")) / 2 - expected
    return j.select(*keys, F.when(top == 0, 1.0).otherwise((F.col("both") - expected) / top).alias("ari"))


def k_distance(features: DataFrame, keys: Sequence[str], unit: str, k: int, vector: str = "v") -> DataFrame:
    """Every unit's distance to its k-th nearest, with its place in the sorted curve of its group."""
    kth = tiles.nearest(features, keys, unit, k, vector).where(F.col("k") == k).select(*keys, F.col("u").alias(unit), F.col("d").alias("kd"))
    return ranked_rows(kth, keys, ["kd", unit], "place")


def knee(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The value of a sorted curve (place, kd) farthest from the chord between its ends."""
    ends = curve.groupBy(*keys).agg(F.min("place").alias("x0"), F.max("place").alias("x1"), F.min_by("kd", "place").alias("y0"), F.max_by("kd", "place").alias("y1"))
    c = curve.join(ends, list(keys)) if keys else curve.crossJoin(F.broadcast(ends))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    gap = F.abs(dy * (F.col("place") - F.col("x0")) - dx * (F.col("kd") - F.col("y0"))) / F.sqrt(dx * dx + dy * dy)
    return c.groupBy(*keys).agg(F.max_by("kd", F.struct(gap, -F.col("place"))).alias("eps"))


def density(edges: DataFrame, units: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges over possible pairs of each group."""
    e, n = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_edges")), units.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.join(e, list(keys), "left").select(*keys, (F.coalesce("n_edges", F.lit(0)) / (F.col("n") * (F.col("n") - 1) / 2)).alias("density"))
