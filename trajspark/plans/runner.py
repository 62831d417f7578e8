"""Grids of experiments: configuration, expansion, skipping what is done, ranking."""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Callable, Iterator, Mapping

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..operators import cluster, evaluate, matrix, reports, segment
from ..operators.stats import weighted_mean


def load(path: str) -> dict:
    with open(path) as f:
        return (json.load(f) if path.endswith(".json") else yaml.safe_load(f)) or {}


def merge(base: Mapping, change: Mapping) -> dict:
    """``base`` with ``change`` laid over it, level by level."""
    out = dict(base)
    for k, v in change.items():
        out[k] = merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def expand(params: Mapping) -> Iterator[dict]:
    """Every combination of the list-valued parameters."""
    lists = {k: v for k, v in params.items() if isinstance(v, list)}
    for combo in itertools.product(*lists.values()):
        yield {**params, **dict(zip(lists, combo, strict=True))}


def only(text: str | None) -> set[int] | None:
    """'1,3-5' as {1, 3, 4, 5}."""
    if not text:
        return None
    out: set[int] = set()
    for part in text.split(","):
        a, _, b = part.strip().partition("-")
        out |= set(range(int(a), int(b or a) + 1))
    return out


def next_id(names: list[str], stem: str) -> int:
    return max((int(m[1]) for n in names if (m := re.search(rf"{re.escape(stem)}_?(\d+)", n))), default=0) + 1


def experiments(base: Mapping, grid: list[Mapping]) -> Iterator[tuple[str, dict]]:
    """(name, configuration) of every experiment: grid entries over the base, lists expanded into folders of their own."""
    for k, entry in enumerate(grid, 1):
        combos = list(expand(entry.get("params", {})))
        for i, params in enumerate(combos):
            name = entry.get("name", f"EXP{k:03d}") + (f"_{i + 1:02d}" if len(combos) > 1 else "")
            yield name, merge(merge(base, {c: v for c, v in entry.items() if c not in ("params", "name")}), {"params": params})


def is_done(folder: str) -> bool:
    spark = SparkSession.active()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/metrics/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def cluster_experiment(features: DataFrame, flow: list[str], unit: str, vector: str, config: Mapping, folder: str, points: DataFrame | None = None) -> None:
    """Labels, counts, scores and the resolved configuration of all flows, written under ``folder``.

    With a ``metric`` other than euclidean in the configuration, distances are precomputed: all pairs, or the candidates
    of ``candidate_k``; the table is cached under ``cache`` if that is set. ``sample`` units of each flow are fitted, if set.
    ``points`` with columns of ``count_by`` give counts by runway or type. A failing flow fails the experiment: no scores are written.
    """
    spark = features.sparkSession
    used = segment.sample_ranked(features, flow, unit, config["sample"], config.get("seed", 11)) if config.get("sample") else features
    params, metric = config.get("params", {}), config.get("metric", "euclidean")
    edges = None
    if metric == "euclidean":
        labels = cluster.cluster_flows(used, flow, unit, vector, config["method"], config.get("max_clusters"), **params)
    else:
        options, k = config.get("metric_params", {}), config.get("candidate_k")
        build = (lambda: matrix.sparse(used, flow, unit, vector, metric, k, **options)) if k else lambda: matrix.dense(used, flow, unit, vector, metric, **options)
        recipe = matrix.recipe(metric, flow, unit, candidate_k=k, sample=config.get("sample"), seed=config.get("seed", 11), data=config.get("data"), **options)
        edges = matrix.cached(spark, config["cache"], recipe, build) if config.get("cache") else cut(build())
        if k and config["method"] == "hdbscan":
            labels = matrix.cluster_components(used, edges, flow, unit, **params)
        elif k and config["method"] == "optics":
            labels, _ = matrix.optics(used, edges, flow, unit, vector, metric, k=k, **params)
        elif k and config["method"] == "dbscan":
            found = cluster.dbscan_edges(used.select(unit), edges, unit, params["eps"], params["min_samples"])
            labels = used.select(*flow, unit).join(found.withColumnRenamed("cluster", "cluster_id"), unit).select(*flow, unit, "cluster_id")
        elif k:
            raise ValueError(f"{config['method']} needs all pairs: leave candidate_k out")
        else:
            labels = matrix.cluster_dense(used, matrix.sanitised(edges, flow, unit), flow, unit, config["method"], config.get("max_clusters"), **params)
    labels.write.mode("overwrite").partitionBy(*flow).parquet(f"{folder}/labels")
    labels = spark.read.parquet(f"{folder}/labels").select(*[F.col(c).cast(t) for c, t in labels.dtypes])
    counts = labels.groupBy(*flow, "cluster_id").agg(F.count(F.lit(1)).alias("n_flights")).withColumn("is_noise_cluster", F.col("cluster_id") < 0)
    counts.write.mode("overwrite").parquet(f"{folder}/cluster_counts")
    if not reports.counts_agree(labels, counts, flow).where("not agrees").isEmpty():
        raise ValueError("cluster counts do not add up to the labels")
    for column in config.get("count_by", []):
        first = points.groupBy(unit).agg(F.min(column).alias(column))
        labels.join(first.dropna(), unit).groupBy(*flow, "cluster_id", column).agg(F.count(F.lit(1)).alias("n_flights")).write.mode("overwrite").parquet(f"{folder}/counts_by_{column}")
    if edges is None:
        full = used.select(*flow, unit, vector).join(labels, [*flow, unit])
        m = evaluate.noise_share(labels, flow, "cluster_id")
        for part in (
            evaluate.silhouette(full, flow, unit, "cluster_id", vector),
            evaluate.davies_bouldin(full, flow, unit, "cluster_id", vector),
            evaluate.calinski_harabasz(full, flow, unit, "cluster_id", vector),
        ):
            m = m.join(part, flow, "left")
    else:
        m = matrix.scores(labels, edges, flow, unit, absent_is_zero=bool(config.get("absent_is_zero")))
    total = features.groupBy(*flow).agg(F.count(F.lit(1)).alias("n_total"))
    m = m.join(total, flow).withColumn("mode", F.lit("sample_only" if config.get("sample") else "all"))
    m.write.mode("overwrite").parquet(f"{folder}/metrics")
    written = spark.read.parquet(f"{folder}/metrics")
    overall(written, ["silhouette", "davies_bouldin", "calinski_harabasz"]).write.mode("overwrite").parquet(f"{folder}/metrics_global")
    spark.createDataFrame([(yaml.safe_dump(dict(config), sort_keys=True),)], "config string").coalesce(1).write.mode("overwrite").text(f"{folder}/config_resolved")


def recomputed(spark: SparkSession, folder: str, edges: DataFrame, flow: list[str], unit: str, **options) -> DataFrame:
    """Scores of an experiment's stored labels from a table of distances, without clustering again."""
    return matrix.scores(spark.read.parquet(f"{folder}/labels"), edges, flow, unit, **options)


def relocated(refs: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """References to files that moved: paths below ``old`` now below ``new``; others stay."""
    at = old.rstrip("/") + "/"
    return refs.withColumn(column, F.when(F.startswith(F.col(column), F.lit(at)), F.concat(F.lit(new.rstrip("/") + "/"), F.substr(F.col(column), F.lit(len(at) + 1)))).otherwise(F.col(column)))


def overall(metrics: DataFrame, names: list[str], weight: str = "n_units", complete: bool = False) -> DataFrame:
    """Means weighted by flights; of each metric where it is known, or only over flows where all are."""
    m = metrics
    if complete:
        for n in names:
            m = m.where(F.col(n).isNotNull())
    return m.agg(*[weighted_mean(F.col(n), F.col(weight)).alias(n) for n in names], F.sum(weight).alias(weight))


def run_grid(base: Mapping, grid: list[Mapping], root: str, run: Callable[[str, dict, str], None], ids: set[int] | None = None) -> dict[str, str]:
    """Status of every experiment: skipped if done, failures noted and left behind."""
    status = {}
    for k, (name, config) in enumerate(experiments(base, grid), 1):
        folder = f"{root}/{name}"
        if ids is not None and k not in ids:
            continue
        if is_done(folder):
            status[name] = "skipped"
            continue
        try:
            run(name, config, folder)
            status[name] = "done"
        except Exception as e:
            status[name] = f"failed: {str(e)[:200]}"
    return status


def promote(grid: list[dict], winners: Mapping[str, str]) -> list[dict]:
    """The grid with each method's winning entry marked."""
    return [{**g, "promoted": g.get("name") in winners.values()} for g in grid]
