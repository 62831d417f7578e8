"""Reports over results: extremes, variation, summaries of experiments, ranks, status tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks
from .stats import composite, weighted_mean


def arg_extremes(df: DataFrame, keys: Sequence[str], cols: Sequence[str], take: Sequence[str], ordinal: str) -> DataFrame:
    """The rows at each column's least and greatest value, one row a group; ties to the first by ``ordinal``."""
    out = []
    for c in cols:
        known = F.col(c).isNotNull()
        low = F.min_by(F.struct(c, *take), F.when(known, F.struct(F.col(c), F.col(ordinal))))
        high = F.min_by(F.struct(c, *take), F.when(known, F.struct(-F.col(c), F.col(ordinal))))
        out += [low.alias(f"min_{c}"), high.alias(f"max_{c}")]
    g = df.groupBy(*keys).agg(*out)
    return g.select(*keys, *[F.col(f"{e}_{c}.{t}").alias(f"{e}_{c}" if t == c else f"{t}_at_{e}_{c}") for c in cols for e in ("min", "max") for t in (c, *take)])


def variation(df: DataFrame, receiver: str, value: str) -> DataFrame:
    """Spread of a receiver's level over the sources: extremes, mean, sample deviation and range; unknown levels don't count."""
    return df.groupBy(receiver).agg(
        F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), (F.max(value) - F.min(value)).alias("range")
    )


def rows_per(df: DataFrame, unit: Column, name: str = "unit") -> DataFrame:
    """How many rows a day, a flight or any other unit has: number of units, mean, median, 5th and 95th percentile."""
    n = df.where(unit.isNotNull()).groupBy(unit.alias(name)).agg(F.count(F.lit(1)).alias("n"))
    q = ranks.quantiles(n, [], "n", {"p5": 0.05, "median": 0.5, "p95": 0.95})
    return n.agg(F.count(F.lit(1)).alias("units"), F.avg("n").alias("mean")).join(q, how="left")  # one row each


def error_per_flow(errors: DataFrame, flow: Sequence[str], error: str, flights: str) -> DataFrame:
    """Mean error of each flow weighted by flights, absolute and squared, with its share of all flights."""
    e = F.col(error)
    g = errors.groupBy(*flow).agg(
        F.sum(flights).alias("n_flights"), weighted_mean(e, F.col(flights)).alias("bias"), weighted_mean(F.abs(e), F.col(flights)).alias("mae"), weighted_mean(e * e, F.col(flights)).alias("mse")
    )
    total = g.agg(F.sum("n_flights").alias("_total"))
    return g.crossJoin(F.broadcast(total)).withColumn("share", F.col("n_flights") / F.col("_total")).drop("_total")  # one row


def best_and_worst(results: DataFrame, keys: Sequence[str], name: str, value: str) -> DataFrame:
    """Of each block or method: experiments with a value, its mean, and the names of least and greatest; ties to the first by name."""
    known = results.where(F.col(value).isNotNull() & ~F.isnan(value))
    return known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("mean"),
        F.min_by(name, F.struct(value, name)).alias("best"),
        F.min(value).alias("best_value"),
        F.min_by(name, F.struct(-F.col(value), F.col(name))).alias("worst"),
        F.max(value).alias("worst_value"),
    )


def label_summary(labels: DataFrame, keys: Sequence[str], flow: Sequence[str], cluster: str) -> DataFrame:
    """Of each experiment: units, noise, flows, clusters, clusters a flow, and flows of more than one cluster."""
    per = labels.groupBy(*keys, *flow).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col(cluster) < 0).alias("_noise"), F.countDistinct(F.when(F.col(cluster) >= 0, F.col(cluster))).alias("_k")
    )
    return per.groupBy(*keys).agg(
        F.sum("_n").alias("n_units"), F.sum("_noise").alias("n_noise"), F.count(F.lit(1)).alias("n_flows"), F.sum("_k").alias("n_clusters"),
        F.avg("_k").alias("clusters_per_flow"), F.max("_k").alias("most_clusters"), F.count_if(F.col("_k") > 1).alias("n_split_flows"),
    )


def counts_agree(labels: DataFrame, counts: DataFrame, keys: Sequence[str], n: str = "n_flights") -> DataFrame:
    """Whether every group's counts add up to its labels: (keys, n_labels, n_counted, agrees), of groups in either table."""
    a = labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_labels"))
    b = counts.groupBy(*keys).agg(F.sum(n).alias("n_counted"))
    j = a.alias("a").join(b.alias("b"), reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]), "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return j.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], zero("n_labels").alias("n_labels"), zero("n_counted").alias("n_counted"), (zero("n_labels") == zero("n_counted")).alias("agrees"))


def ranked_results(results: DataFrame, name: str, value: str, descending: bool = False) -> DataFrame:
    """Competition rank by value, equal ones alike; a result without a value has none."""
    signed = results.withColumn("_v", -F.col(value) if descending else F.col(value))
    less = ranks.counted_values(signed, [], "_v").select("_v", (F.col("less") + 1).alias("rank"))
    return signed.join(less, "_v", "left").select(name, value, "rank")


def winners(results: DataFrame, method: str, name: str, eligible: Column, metrics: tuple[str, str, str, str]) -> DataFrame:
    """The best experiment of each method by the composite score, eligible ones before all others, ties to the first by name."""
    s = composite(results, *metrics).withColumn("eligible", F.coalesce(eligible, F.lit(False)))
    best = F.max_by(F.struct(name, "score", "eligible"), F.struct(F.col("eligible"), F.col("score"), -F.xxhash64(name)))
    first = s.groupBy(method).agg(best.alias("_b"))
    # Equal scores: by name, not by hash.
    tied = s.join(first.select(F.col(method).alias("_m"), F.col("_b.score").alias("_s"), F.col("_b.eligible").alias("_e")), (F.col(method) == F.col("_m")) & F.col("score").eqNullSafe(F.col("_s")) & (F.col("eligible") == F.col("_e")))
    return tied.groupBy(method).agg(F.min(name).alias(name), F.first("score").alias("score"), F.first("eligible").alias("eligible"))


def master(metrics: DataFrame, experiment: str, flow: Sequence[str], values: Sequence[str], weight: str) -> DataFrame:
    """One row of each experiment over all its flows (``scope`` overall, weighted) and one for each flow."""
    overall = metrics.groupBy(experiment).agg(F.sum(weight).alias(weight), *[weighted_mean(F.col(v), F.col(weight)).alias(v) for v in values])
    overall = overall.select(experiment, F.lit("overall").alias("scope"), *[F.lit(None).cast(metrics.schema[f].dataType).alias(f) for f in flow], weight, *values)
    each = metrics.select(experiment, F.lit("flow").alias("scope"), *flow, weight, *values)
    return overall.unionByName(each)


def audit(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Two files' metadata of the same flights: how many are in both or one, and 95th percentile and most of each column's change."""
    l = a.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in cols], F.lit(1).alias("_in_a"))
    r = b.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in cols], F.lit(1).alias("_in_b"))
    j = l.join(r, list(keys), "full").withColumns({f"_d_{c}": F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}")).cast("double") for c in cols})
    found = j.agg(
        F.count_if(F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()).alias("both"), F.count_if(F.col("_in_b").isNull()).alias("left_only"), F.count_if(F.col("_in_a").isNull()).alias("right_only"),
        *[F.max(f"_d_{c}").alias(f"max_{c}") for c in cols],
    )
    for c in cols:
        found = found.join(ranks.quantiles(j, [], f"_d_{c}", {f"p95_{c}": 0.95}), how="left")  # one row each
    return found


def status(expected: DataFrame, found: DataFrame, key: str, values: Mapping[str, Column]) -> DataFrame:
    """Every expected id with its report's values and ``status``: done, or missing with nulls in their places."""
    f = found.select(F.col(key).alias("_key"), *[c.alias(n) for n, c in values.items()], F.lit(True).alias("_done"))
    return expected.join(f, expected[key] == F.col("_key"), "left").select(key, *values, F.when(F.col("_done"), "done").otherwise("missing").alias("status"))


def correlation_matrix(df: DataFrame, scopes: Mapping[str, Column], features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Pearson of every feature with every target, in every scope: (scope, feature, target, n, pearson)."""
    marked = df.select(F.explode(F.array_compact(F.array(*[F.when(on, F.lit(name)) for name, on in scopes.items()]))).alias("scope"), *features, *targets)
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(t).alias("target"), F.col(f).cast("double").alias("x"), F.col(t).cast("double").alias("y")) for f in features for t in targets])
    rows = marked.select("scope", F.inline(pairs)).where("x is not null and y is not null")
    ok = (F.count(F.lit(1)) >= 3) & (F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))
    return rows.groupBy("scope", "feature", "target").agg(F.count(F.lit(1)).alias("n"), F.when(ok, F.corr("x", "y")).alias("pearson"))
