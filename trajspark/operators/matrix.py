"""Precomputed distances: from feature vectors to an edge table, and from that to clusters and their scores.

An edge table has one row a pair (keys, unit_a < unit_b, d); a pair that is absent is far. It is sparse
(each unit's nearest in a cheap distance, thinned by a threshold and a lower bound, then measured by
the costly one) or dense (all pairs, by tiles). It is written once under a name made of its recipe.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.writers import cache_path
from . import cluster, distance, evaluate, ranks, tiles
from .graph import components


def tau(near: DataFrame, keys: Sequence[str], quantile: float = 0.9, scale: float = 1.0, explicit: float | None = None) -> DataFrame:
    """(keys, tau): the given threshold, or each group's quantile of all directed neighbour distances, scaled."""
    if explicit is not None:
        return near.select(*keys).distinct().withColumn("tau", F.lit(float(explicit)))
    return ranks.quantiles(near, keys, "d", {"tau": quantile}).withColumn("tau", F.col("tau") * scale)


def sparse(df: DataFrame, keys: Sequence[str], unit: str, v: str, metric: str, k: int = 30, least_neighbours: int = 1, quantile: float | None = 0.9, scale: float = 1.0, explicit: float | None = None, bound_radius: int | None = None, dims: int = 2, **options) -> DataFrame:
    """Candidate pairs (each unit's ``k`` nearest, at least ``least_neighbours``) measured by ``metric``.

    With a ``quantile`` or an explicit threshold, candidates farther than tau in the cheap distance go, and with
    ``bound_radius`` those whose lower bound of the squared warping distance exceeds it. Infinite distances go.
    """
    near = tiles.nearest(df, keys, unit, max(k, least_neighbours), v)
    a, b = f"{unit}_a", f"{unit}_b"
    edges = near.select(*keys, F.least("u", "v").alias(a), F.greatest("u", "v").alias(b), "d").distinct()
    limited = quantile is not None or explicit is not None
    if limited:
        edges = ranks.beside(edges, tau(near, keys, quantile or 0.9, scale, explicit), keys).where(F.col("d") <= F.col("tau"))
    vectors = df.select(unit, F.col(v).cast("array<double>").alias("_v"))
    pairs = edges.join(vectors.select(F.col(unit).alias(a), F.col("_v").alias("_va")), a).join(vectors.select(F.col(unit).alias(b), F.col("_v").alias("_vb")), b)
    if limited and bound_radius is not None:
        from ..functions.arrays import envelope, envelope_bound

        pairs = pairs.where(F.coalesce(F.sqrt(envelope_bound(F.col("_va"), envelope(F.col("_vb"), bound_radius))) <= F.col("tau"), F.lit(True)))
    measured = distance.with_distance(pairs.select(*keys, a, b, "_va", "_vb"), "_va", "_vb", metric, "d", dims, **options)
    return measured.where(~F.isnan("d") & (F.col("d") < float("inf")))


def dense(df: DataFrame, keys: Sequence[str], unit: str, v: str, metric: str, dims: int = 2, **options) -> DataFrame:
    """All pairs of each group by ``metric``."""
    return tiles.pair_values(df, keys, unit, distance.flat_measure(metric, dims, **options), v)


def sanitised(edges: DataFrame, keys: Sequence[str], unit: str) -> DataFrame:
    """One row a pair: both directions averaged, a unit's distance to itself left out; an unknown or infinite distance is an error."""
    bad = edges.where(F.col("d").isNull() | F.isnan("d") | (F.abs("d") == float("inf"))).count()
    if bad:
        raise ValueError(f"{bad} distances are not finite")
    a, b = f"{unit}_a", f"{unit}_b"
    other = edges.where(F.col(a) != F.col(b))
    return other.groupBy(*keys, F.least(a, b).alias(a), F.greatest(a, b).alias(b)).agg(F.avg("d").alias("d"))


def cached(spark: SparkSession, root: str, recipe: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of this recipe: read if it was written to its end before, else built and written."""
    path = cache_path(root, **recipe)
    jvm = spark._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _square(units: np.ndarray, e: pd.DataFrame, a: str, b: str, absent: float) -> np.ndarray:
    at = {u: i for i, u in enumerate(units.tolist())}
    d = np.full((len(units), len(units)), absent)
    i, j = e[a].map(at).to_numpy(), e[b].map(at).to_numpy()
    d[i, j] = d[j, i] = e["d"].to_numpy()
    np.fill_diagonal(d, 0)
    return d


def cluster_dense(units: DataFrame, edges: DataFrame, keys: Sequence[str], unit: str, name: str, max_clusters: int | None = None, **params) -> DataFrame:
    """(keys, unit, cluster_id) by a named clusterer over each group's whole matrix; a missing pair is an error."""
    a, b = f"{unit}_a", f"{unit}_b"
    schema = ", ".join(f"`{c}` {t}" for c, t in units.select(*keys, unit).dtypes) + ", cluster_id int"

    def run(key: tuple, u: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        u = u.sort_values(unit)
        n = len(u)
        if n > cluster.MOST_UNITS:
            raise ValueError(f"{n} units in flow {key}; use dbscan_edges or cluster_components beyond {cluster.MOST_UNITS}")
        if len(e) != n * (n - 1) // 2:
            raise ValueError(f"flow {key}: {n * (n - 1) // 2 - len(e)} pairs are missing")
        lab = cluster.clusterer(name, **params)(_square(u[unit].to_numpy(), e, a, b, np.inf), True) if n else np.zeros(0, int)
        if max_clusters is not None:
            lab = np.where(lab < max_clusters, lab, -1)
        return u[[*keys, unit]].assign(cluster_id=lab.astype(np.int32))

    left = units.select(*[F.col(c).alias(c) for c in [*keys, unit]])
    right = edges.select(*[F.col(c).alias(c) for c in [*keys, a, b, "d"]])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def cluster_components(units: DataFrame, edges: DataFrame, keys: Sequence[str], unit: str, **params) -> DataFrame:
    """(keys, unit, cluster_id) by HDBSCAN inside each connected component of a sparse table; single units are noise.

    A component is a task of its own. Within one, an absent pair is as far as the way along its edges at least:
    farther than any edge. Clusters are numbered through the components of a group, by their first unit.
    """
    a, b = f"{unit}_a", f"{unit}_b"
    roots = components(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))).select(F.col("node").alias(unit), F.col("root").alias("_root"))
    kind = dict(units.dtypes)
    named = ", ".join(f"`{k}` {kind[k]}" for k in keys)

    def run(e: pd.DataFrame) -> pd.DataFrame:
        own = np.unique(np.concatenate([e[a].to_numpy(), e[b].to_numpy()]))
        far = 2 * e["d"].max() + 1
        d = cluster.SparseRows(len(own), np.searchsorted(own, e[a]), np.searchsorted(own, e[b]), e["d"].to_numpy(), far)
        lab = cluster.hdbscan(d, **params) if len(own) >= params.get("min_cluster_size", 5) else np.full(len(own), -1)
        lab = cluster.by_first(lab)
        first = {c: own[np.flatnonzero(lab == c)[0]] for c in range(lab.max() + 1)}
        return pd.DataFrame({**{k: [e[k].iloc[0]] * len(own) for k in keys}, unit: own, "_first": [first.get(c) for c in lab]}).astype({"_first": "Int64"})

    placed = edges.join(roots, edges[a] == roots[unit]).drop(unit)
    schema = (named + ", " if named else "") + f"`{unit}` {kind[unit]}, _first long"
    lab = placed.groupBy(*keys, "_root").applyInPandas(run, schema)
    numbers = ranks.ranked_rows(lab.where("_first is not null").select(*keys, "_first").distinct(), keys, ["_first"], "_number")
    known = ranks.beside(lab, numbers.withColumn("_number", F.col("_number") - 1), [*keys, "_first"])
    return ranks.beside(units.select(*keys, unit), known.select(*keys, unit, "_number"), [*keys, unit]).select(*keys, unit, F.coalesce("_number", F.lit(-1)).cast("int").alias("cluster_id"))


def optics(df: DataFrame, edges: DataFrame, keys: Sequence[str], unit: str, v: str, metric: str, min_samples: int = 5, k: int = 30, **params) -> tuple[DataFrame, str]:
    """OPTICS over a sparse table (labels, how): as it is if every unit has ``min_samples`` neighbours, else over a relaxed one.

    The relaxed table has at least max(k, 4 min_samples, 80) neighbours a unit, no threshold and no bound.
    """
    a, b = f"{unit}_a", f"{unit}_b"
    both = edges.select(F.col(a).alias(unit)).unionAll(edges.select(F.col(b).alias(unit)))
    enough = both.groupBy(unit).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_samples - 1)
    thin = not df.join(enough, unit, "left_anti").isEmpty()
    if thin:
        edges = sparse(df, keys, unit, v, metric, max(k, 4 * min_samples, 80), quantile=None)
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keys, unit).dtypes) + ", cluster_id int"

    def run(key: tuple, u: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        u = u.sort_values(unit)
        far = 2 * e["d"].max() + 1 if len(e) else 1.0
        lab = cluster.clusterer("optics", min_samples=min_samples, **params)(_square(u[unit].to_numpy(), e, a, b, far), True)
        return u[[*keys, unit]].assign(cluster_id=lab.astype(np.int32))

    left = df.select(*[F.col(c).alias(c) for c in [*keys, unit]])
    right = edges.select(*[F.col(c).alias(c) for c in [*keys, a, b, "d"]])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema), "relaxed" if thin else "as given"


def mds_scores(labels: DataFrame, edges: DataFrame, keys: Sequence[str], unit: str, label: str = "cluster_id", dims: int = 8) -> DataFrame:
    """Davies-Bouldin and Calinski-Harabasz of coordinates that classical scaling finds for the labelled units' distances."""
    a, b = f"{unit}_a", f"{unit}_b"
    lab = labels.where(F.col(label) >= 0)
    schema = ", ".join(f"`{c}` {t}" for c, t in lab.select(*keys, unit).dtypes) + ", v array<double>"

    def run(key: tuple, u: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        u = u.sort_values(unit)
        if not len(u):
            return u[[*keys, unit]].assign(v=[])
        inside = e[e[a].isin(set(u[unit])) & e[b].isin(set(u[unit]))]
        x = cluster.classical_mds(_square(u[unit].to_numpy(), inside, a, b, 0.0), dims)
        return u[[*keys, unit]].assign(v=x.tolist())

    left = lab.select(*[F.col(c).alias(c) for c in [*keys, unit]])
    right = edges.select(*[F.col(c).alias(c) for c in [*keys, a, b, "d"]])
    f = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema).join(lab.select(*keys, unit, label), [*keys, unit])
    db, ch = evaluate.davies_bouldin(f, keys, unit, label, "v"), evaluate.calinski_harabasz(f, keys, unit, label, "v")
    return db.join(ch, list(keys), "full")


def scores(labels: DataFrame, edges: DataFrame, keys: Sequence[str], unit: str, label: str = "cluster_id", absent_is_zero: bool = False, most: int = 1_500) -> DataFrame:
    """Noise share, silhouette and scores on scaled coordinates from a table of distances, also one read again from the cache.

    A group whose labelled units lack a pair has no scores, reason 'sparse'; with ``absent_is_zero``, groups of up to
    ``most`` units take an absent pair as 0 apart, as older results did.
    """
    a, b = f"{unit}_a", f"{unit}_b"
    lab = labels.where(F.col(label) >= 0).select(*keys, unit)
    inside = edges.join(lab.withColumnRenamed(unit, a), [*keys, a]).join(lab.withColumnRenamed(unit, b), [*keys, b])
    have = inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("_pairs"))
    base = ranks.beside(evaluate.noise_share(labels, keys, label), have, keys)
    n = F.col("n_units") - F.col("n_noise")
    whole = F.coalesce("_pairs", F.lit(0)) == n * (n - 1) / 2
    if absent_is_zero:
        whole = whole | (n <= most)
        every = lab.withColumnRenamed(unit, a).join(lab.withColumnRenamed(unit, b), list(keys)).where(F.col(a) < F.col(b))
        edges = every.join(edges, [*keys, a, b], "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
    base = base.withColumn("_whole", whole)
    s = evaluate.silhouette_of_edges(edges, labels, keys, unit, label)
    j = ranks.beside(ranks.beside(base, s, keys), mds_scores(labels, edges, keys, unit, label), keys)
    known = F.col("_whole") & (F.col("n_clusters") >= 2)
    reason = F.when(F.col("n_clusters") < 2, "<2 clusters").when(~F.col("_whole"), "sparse")
    return j.select(*keys, "n_units", "n_noise", "n_clusters", "noise_frac", *[F.when(known, F.col(c)).alias(c) for c in ("silhouette", "davies_bouldin", "calinski_harabasz")], reason.alias("reason"))


def recipe(metric: str, keys: Sequence[str], unit: str, **params) -> dict:
    """What names a cached table: everything that its numbers depend on."""
    return json.loads(json.dumps({"metric": metric, "keys": list(keys), "unit": unit, **params}, sort_keys=True, default=str))
