"""Queries over tracks and vectors: distances, neighbours, features, clusters and their scores, side tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import cluster, distance, evaluate, features, resample, signal, stats, tiles
from ..operators import tracks as side
from ..operators.graph import components
from .registry import ORACLE_SQL, TRACKS, VECTORS, query, r, signed, tracks, vectors

GROUPS = [(0, 7, 4.0), (24, 31, 0.5)]
_DIST = "list_sum(list_transform(range(1, 65), lambda i: power(a.v[i] - b.v[i], 2)))"
_PAIRS = f"{VECTORS}, pairs as (select a.flow, a.flight_id as a_id, b.flight_id as b_id, sqrt({_DIST}) as d from vectors a join vectors b on a.flow = b.flow and a.flight_id < b.flight_id)"
_BOTH = "both_ as (select flow, a_id as u, b_id as v, d from pairs union all select flow, b_id, a_id, d from pairs)"
_KNN = lambda k: f"near as (select * from both_ qualify row_number() over (partition by u order by d, v) <= {k}), edges as (select distinct flow, least(u, v) as a_id, greatest(u, v) as b_id, d from near)"


def _pairs(spark, d, within=None):
    return tiles.pair_distances(vectors(spark, d), ["flow"], "flight_id", within=within)


def _edges(spark, d, k):
    return tiles.nearest_edges(vectors(spark, d), ["flow"], "flight_id", k)


def _edge_tracks(spark, d, k=5):
    """Candidate pairs for the costly distances: each track's nearest in the plain one."""
    v = vectors(spark, d).select("flight_id", "v")
    e = _edges(spark, d, k).select("flow", "flight_id_a", "flight_id_b")
    a, b = v.select(F.col("flight_id").alias("flight_id_a"), F.col("v").alias("v_a")), v.select(F.col("flight_id").alias("flight_id_b"), F.col("v").alias("v_b"))
    return e.join(a, "flight_id_a").join(b, "flight_id_b")


@query(f"with {_PAIRS} select flow, a_id as flight_id_a, b_id as flight_id_b, round(d, 6) as d from pairs")
def pairwise_euclid(spark, d):
    return _pairs(spark, d).select("flow", "flight_id_a", "flight_id_b", r("d").alias("d"))


_W = ", ".join(str(w) + "::double" for w in arrays.point_weights(32, GROUPS))


@query(f"with {VECTORS}, w as (select [{_W}] as w) select a.flow, a.flight_id as flight_id_a, b.flight_id as flight_id_b, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: w.w[i] * power(a.v[i] - b.v[i], 2)))), 6) as d from vectors a join vectors b on a.flow = b.flow and a.flight_id < b.flight_id, w")
def weighted_euclid(spark, d):
    s = vectors(spark, d).withColumn("v", arrays.scaled(F.col("v"), arrays.point_weights(32, GROUPS)))
    return tiles.pair_distances(s, ["flow"], "flight_id").withColumn("d", r("d"))


@query(f"with {_PAIRS}, {_BOTH}, {_KNN(5)} select flow, a_id as flight_id_a, b_id as flight_id_b, round(d, 6) as d from edges")
def knn_join(spark, d):
    return _edges(spark, d, 5).select("flow", "flight_id_a", "flight_id_b", r("d").alias("d"))


@query(f"with {_PAIRS}, {_BOTH}, {_KNN(5)} select flow, round(quantile_cont(d, 0.9), 6) as tau from near group by flow")
def tau_quantile(spark, d):
    near = tiles.nearest(vectors(spark, d), ["flow"], "flight_id", 5)
    return near.groupBy("flow").agg(r(F.percentile("d", F.lit(0.9))).alias("tau"))


@query(f"""with {VECTORS} select a.flow, a.flight_id as flight_id_a, b.flight_id as flight_id_b,
    round(list_sum(list_transform(range(1, 65), lambda i: power(greatest(a.v[i] - list_max(b.v[greatest(i - 3, 1):least(i + 3, 64)]), list_min(b.v[greatest(i - 3, 1):least(i + 3, 64)]) - a.v[i], 0), 2))), 6) as bound
    from vectors a join vectors b on a.flow = b.flow and a.flight_id < b.flight_id""")
def lower_bound_keogh(spark, d):
    p = tiles.pair_values(vectors(spark, d), ["flow"], "flight_id", distance.keogh(3), name="bound", symmetric=False)
    return p.withColumn("bound", r("bound"))


def _dp_sql(cost: str, first: str, step: str, final: str = "row[32]", edges: str = _KNN(5)) -> str:
    """A dynamic program over 32 x 32 cells: a recursion over rows, each folded from the left."""
    c = cost
    return f"""
    with recursive {_PAIRS}, {_BOTH}, {edges},
    e as (select e.flow, e.a_id, e.b_id, list_transform(range(1, 33), lambda i: [a.v[2 * i - 1], a.v[2 * i]]) as p, list_transform(range(1, 33), lambda i: [b.v[2 * i - 1], b.v[2 * i]]) as q
          from edges e join vectors a on a.flight_id = e.a_id join vectors b on b.flight_id = e.b_id),
    dp as (select flow, a_id, b_id, p, q, 1 as i, list_reduce(list_transform(range(1, 33), lambda j: [j::double]), lambda acc, x: list_append(acc, {first.replace('COST', c.replace('I', '1').replace('J', 'x[1]::int'))}), []::double[]) as row from e
           union all
           select flow, a_id, b_id, p, q, i + 1, list_reduce(list_transform(range(1, 33), lambda j: [j::double]), lambda acc, x: list_append(acc, {step.replace('COST', c.replace('I', '(i + 1)').replace('J', 'x[1]::int'))}), []::double[]) from dp where i < 32)
    select flow, a_id as flight_id_a, b_id as flight_id_b, round({final}, 6) as d from dp where i = 32
    """


_EUC = "sqrt(power(p[I][1] - q[J][1], 2) + power(p[I][2] - q[J][2], 2))"
_SQ = "(power(p[I][1] - q[J][1], 2) + power(p[I][2] - q[J][2], 2))"
_ALL = "edges as (select flow, a_id, b_id, d from pairs)"
_BAND_FIRST = "case when abs(1 - x[1]) > 4 then 'infinity'::double when x[1] = 1 then COST else acc[x[1]::int - 1] + COST end"
_MAX_FIRST = "case when x[1] = 1 then COST else greatest(acc[x[1]::int - 1], COST) end"
_MAX_STEP = "case when x[1] = 1 then greatest(row[1], COST) else greatest(COST, least(row[x[1]::int - 1], row[x[1]::int], acc[x[1]::int - 1])) end"
_SUM_FIRST = "case when x[1] = 1 then COST else acc[x[1]::int - 1] + COST end"


def _sum_step(diag: int, band: int | None = None) -> str:
    out = f"case when x[1] = 1 then row[1] + COST else least(row[x[1]::int - 1] + {diag} * COST, row[x[1]::int] + COST, acc[x[1]::int - 1] + COST) end"
    return out if band is None else f"case when abs(i + 1 - x[1]) > {band} then 'infinity'::double else {out} end"


def _dense(spark, d, name, crossed=False, **options):
    """A costly distance of every pair of a flow; ``crossed`` gives the kernel two blocks instead of lists of pairs."""
    return tiles.pair_values(vectors(spark, d), ["flow"], "flight_id", distance.flat_measure(name, **options), crossed=crossed).withColumn("d", r("d"))


def _dp(spark, d, name, k=5, **options):
    """A costly distance of the pairs of each track and its ``k`` nearest; the SQL of the queries has 5, the reference 30."""
    return distance.with_distance(_edge_tracks(spark, d, k), "v_a", "v_b", name, "d", **options).select("flow", "flight_id_a", "flight_id_b", r("d").alias("d"))


@query(_dp_sql(_EUC, _SUM_FIRST, _sum_step(2)))
def dtw_symmetric2(spark, d):
    return _dp(spark, d, "dtw")


@query(_dp_sql(_EUC, _SUM_FIRST, _sum_step(1)))
def dtw_symmetric1(spark, d):
    return _dp(spark, d, "dtw_symmetric1")


@query(_dp_sql(_SQ, _BAND_FIRST, _sum_step(1, 4), "sqrt(row[32])"))
def dtw_banded(spark, d):
    return _dp(spark, d, "dtw_banded", window=4)


@query(_dp_sql(_EUC, _MAX_FIRST, _MAX_STEP))
def frechet_discrete(spark, d):
    return _dp(spark, d, "frechet")


_LCSS = f"""
    with recursive {_PAIRS},
    e as (select a.flow, a.flight_id as a_id, b.flight_id as b_id, axis, list_transform(range(1, 33), lambda i: a.v[2 * i - 1 + axis]) as p, list_transform(range(1, 33), lambda i: b.v[2 * i - 1 + axis]) as q
          from vectors a join vectors b on a.flow = b.flow and a.flight_id < b.flight_id, unnest([0, 1]) as u(axis)),
    dp as (select *, 0 as i, list_transform(range(0, 33), lambda x: 0::bigint) as row from e
           union all
           select flow, a_id, b_id, axis, p, q, i + 1, list_reduce(list_transform(range(1, 33), lambda j: [j]), lambda acc, x: list_append(acc,
               case when abs(p[i + 1] - q[x[1]]) <= 0.1 and abs(i + 1 - x[1]) <= 4 then row[x[1]] + 1 else greatest(row[x[1] + 1], acc[x[1]]) end), [0]::bigint[]) from dp where i < 32)
    select flow, a_id as flight_id_a, b_id as flight_id_b, round(least(greatest(1 - avg(row[33] / 32.0::double), 0), 1), 6) + 0.0 as d from dp where i = 32 group by flow, a_id, b_id
"""


@query(_LCSS)
def lcss_distance(spark, d):
    return _dense(spark, d, "lcss", epsilon=0.1, alpha=0.1)


@query(_dp_sql(_EUC, _SUM_FIRST, _sum_step(2), edges=_ALL))
def dtw_symmetric2_dense(spark, d):
    return _dense(spark, d, "dtw")


@query(_dp_sql(_EUC, _SUM_FIRST, _sum_step(1), edges=_ALL))
def dtw_symmetric1_dense(spark, d):
    return _dense(spark, d, "dtw_symmetric1", crossed=True)


@query(_dp_sql(_SQ, _BAND_FIRST, _sum_step(1, 4), "sqrt(row[32])", edges=_ALL))
def dtw_banded_dense(spark, d):
    return _dense(spark, d, "dtw_banded", crossed=True, window=4)


@query(_dp_sql(_EUC, _MAX_FIRST, _MAX_STEP, edges=_ALL))
def frechet_discrete_dense(spark, d):
    return _dense(spark, d, "frechet")


def _path_sql(first: str, step: str, steps: list[str]) -> str:
    """The whole matrix of a dynamic program for each track and its nearest, walked back from its last cell; ``steps`` are [value, order, i, j]."""
    dp = _dp_sql(_EUC, first, step, edges=_KNN(1))
    cost = "sqrt(power(p[I][1] - q[J][1], 2) + power(p[I][2] - q[J][2], 2))".replace("I", "w.i").replace("J", "w.j")
    return dp[: dp.rindex("select flow, a_id as flight_id_a")].rstrip() + f""",
    m as (select a_id, b_id, any_value(p) as p, any_value(q) as q, list(row order by i) as g from dp group by a_id, b_id),
    walk as (select a_id, b_id, 0 as back, 32 as i, 32 as j from m
             union all
             select a_id, b_id, back + 1, s[3]::int, s[4]::int from (select w.a_id, w.b_id, w.back, list_sort(list_filter([{", ".join(steps)}], lambda z: z[1] is not null))[1] as s
             from (select walk.*, g, {cost.replace("w.", "walk.")} as c from walk join m using (a_id, b_id)) w where w.i > 1 or w.j > 1))
    select a_id as flight_id_a, b_id as flight_id_b, (max(back) over (partition by a_id, b_id) - back)::int as place, (w.i - 1)::int as i, (w.j - 1)::int as j, round({cost}, 6) as local, round(g[w.i][w.j], 6) as cumulative
    from walk w join m using (a_id, b_id)
    """


_IF = "case when {0} then {1} end"
_DTW_STEPS = [
    f"[{_IF.format('w.i > 1 and w.j > 1', 'g[w.i - 1][w.j - 1] + 2 * c')}, 0, w.i - 1, w.j - 1]",
    f"[{_IF.format('w.i > 1', 'g[w.i - 1][w.j] + c')}, 1, w.i - 1, w.j]",
    f"[{_IF.format('w.j > 1', 'g[w.i][w.j - 1] + c')}, 2, w.i, w.j - 1]",
]
_MAX_STEPS = [
    f"[{_IF.format('w.i > 1', 'g[w.i - 1][w.j]')}, 0, w.i - 1, w.j]",
    f"[{_IF.format('w.j > 1', 'g[w.i][w.j - 1]')}, 1, w.i, w.j - 1]",
    f"[{_IF.format('w.i > 1 and w.j > 1', 'g[w.i - 1][w.j - 1]')}, 2, w.i - 1, w.j - 1]",
]


@query(_path_sql(_SUM_FIRST, _sum_step(2), _DTW_STEPS))
def dtw_alignment(spark, d):
    p = distance.path_rows(_edge_tracks(spark, d, 1), "v_a", "v_b", "dtw")
    return p.select("flight_id_a", "flight_id_b", "place", "i", "j", r("local").alias("local"), r("cumulative").alias("cumulative"))


@query(_path_sql(_MAX_FIRST, _MAX_STEP, _MAX_STEPS))
def frechet_coupling(spark, d):
    p = distance.path_rows(_edge_tracks(spark, d, 1), "v_a", "v_b", "frechet")
    return p.select("flight_id_a", "flight_id_b", "place", "i", "j", r("local").alias("local"), r("cumulative").alias("cumulative"))


_SENSE = _dp_sql(_EUC, _SUM_FIRST, _sum_step(2))
_RANK = "rank() over (partition by flow order by {0}) + (count(*) over (partition by flow, {0}) - 1) / 2.0::double"


@query(_SENSE[: _SENSE.rindex("select flow, a_id as flight_id_a")].rstrip() + f""",
    j as (select edges.flow, edges.d as plain, dp.row[32] as warped from edges join dp on dp.i = 32 and dp.a_id = edges.a_id and dp.b_id = edges.b_id),
    k as (select *, {_RANK.format("plain")} as ra, {_RANK.format("warped")} as rb from j)
    select flow, count(*) as n, round(corr(plain, warped), 6) as pearson, round(corr(ra, rb), 6) as spearman, case when corr(plain, warped) < 0.6 then 'sensitive' else 'robust' end as verdict from k group by flow""")
def speed_sensitivity(spark, d):
    """Correlation of index distance and warping distance of candidate pairs, and the verdict on it."""
    e = _edge_tracks(spark, d).withColumn("plain", arrays.euclid(F.col("v_a"), F.col("v_b")))
    j = distance.with_distance(e, "v_a", "v_b", "dtw", "warped")
    c = stats.correlations(j, ["flow"], "plain", "warped")
    return c.select("flow", "n", r("pearson").alias("pearson"), r("spearman").alias("spearman"), F.when(F.col("pearson") < 0.6, "sensitive").otherwise("robust").alias("verdict"))


@query(f"with {_PAIRS} select flow, count(*) as n, round(avg(d), 6) as mean_d, round(median(d), 6) as median_d from pairs group by flow")
def distance_scales(spark, d):
    s = tiles.pair_scales(vectors(spark, d), ["flow"], "flight_id")
    return s.select("flow", "n", r("mean").alias("mean_d"), r("median").alias("median_d"))


@query(f"with {TRACKS} select flow, flight_id, list(round(x, 6) order by step) as xs, list(round(y, 6) order by step) as ys, count(*) as n from tracks group by flow, flight_id")
def feature_matrix(spark, d):
    m = features.matrix(tracks(spark, d), ["flow"], "flight_id", ["x", "y"], n_points=32)
    axis = lambda k: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: signed(F.get("v", 2 * i + k)))
    return m.select("flow", "flight_id", axis(0).alias("xs"), axis(1).alias("ys"), (F.size("v") / 2).cast("long").alias("n"))


@query(f"with {VECTORS}, l as (select flow, flight_id, i - 1 as dim, v[i] as x from vectors, unnest(range(1, 65)) as u(i)), s as (select flow, dim, avg(x) as m, stddev_pop(x) as s from l group by flow, dim) select l.flow, l.flight_id, l.dim::int as dim, round((x - m) / case when s > 0 then s else 1 end, 6) + 0.0 as x from l join s using (flow, dim)")
def standardised_features(spark, d):
    s = features.standardise(vectors(spark, d), ["flow"], "flight_id")
    return s.select("flow", "flight_id", F.posexplode("v").alias("dim", "x")).withColumn("x", r("x"))


@query(f"""with {VECTORS}, l as (select flow, flight_id, i - 1 as dim, case when abs(v[i]) > 0.2 then null else v[i] end as x from vectors, unnest(range(1, 65)) as u(i)),
    s as (select flow, dim, median(x) as m from l group by flow, dim) select l.flow, l.flight_id, l.dim::int as dim, round(coalesce(x, m, 0), 6) + 0.0 as x from l join s using (flow, dim)""")
def imputed_features(spark, d):
    holes = vectors(spark, d).withColumn("v", F.transform("v", lambda x: F.when(F.abs(x) <= 0.2, x)))
    s = features.impute(holes, ["flow"], "flight_id", how="median")
    return s.select("flow", "flight_id", F.posexplode("v").alias("dim", "x")).withColumn("x", r("x"))


@query(f"""with {VECTORS}, l as (select flow, flight_id, i, case when abs(v[i]) > 0.2 then null else v[i] end as x from vectors, unnest(range(1, 65)) as u(i)),
    w as (select *, last_value(case when x is not null then i end ignore nulls) over p as bi, last_value(x ignore nulls) over p as bx, first_value(case when x is not null then i end ignore nulls) over n as ai, first_value(x ignore nulls) over n as ax from l
          window p as (partition by flight_id order by i rows between unbounded preceding and current row), n as (partition by flight_id order by i rows between current row and unbounded following))
    select flow, flight_id, (i - 1)::int as dim, round(case when bi is null then ax when ai is null or ai = bi then bx else bx + (ax - bx) * (i - bi) / (ai - bi) end, 6) + 0.0 as x from w""")
def filled_gaps(spark, d):
    holes = vectors(spark, d).withColumn("v", F.transform("v", lambda x: F.when(F.abs(x) <= 0.2, x)))
    s = holes.withColumn("v", features.fill_gaps(F.col("v")))
    return s.select("flow", "flight_id", F.posexplode("v").alias("dim", "x")).withColumn("x", r("x"))


@query()
def principal_components(spark, d):
    v = vectors(spark, d)
    mean, axes, _ = features.principal_axes(v, "v", 3)
    return features.project(v, "v", mean, axes).select("flow", "flight_id", F.transform("pc", lambda x: r(x, 5)).alias("pc"))


@query()
def explained_variance(spark, d):
    shares = features.principal_axes(vectors(spark, d), "v", 5)[2]
    return spark.createDataFrame([(k + 1, round(float(x), 6)) for k, x in enumerate(shares)], "component int, share double")


@query(f"""with {VECTORS}, l as (select flow, flight_id, k, unnest([0, 1]) as axis, v from vectors, unnest(range(0, 16)) as u(k)), p as (select *, 31 * k / 15.0::double as p, floor(31 * k / 15.0::double)::int as i from l)
    select flow, flight_id, (2 * k + axis)::int as dim, round(v[2 * i + axis + 1] + (v[2 * least(i + 1, 31) + axis + 1] - v[2 * i + axis + 1]) * (p - i), 6) + 0.0 as x from p""")
def knn_embedding(spark, d):
    return vectors(spark, d).select("flow", "flight_id", F.posexplode(features.embed(F.col("v"))).alias("dim", "x")).withColumn("x", r("x"))


@query()
def simplify_rdp(spark, d):
    t = resample.collect_tracks(tracks(spark, d), ["flow", "flight_id"], ["step"], ["step", "x", "y"])
    s = resample.simplify_tracks(t, "x", "y", 0.2, ["step"])
    return resample.to_steps(s.drop("n").withColumnRenamed("step", "at"), ["flow", "flight_id"], ["at", "x", "y"]).select("flow", "flight_id", "step", F.col("at").cast("int").alias("at"), r("x").alias("x"), r("y").alias("y"))


_LABELS = "labels_ as (select flow, flight_id, case when flight_id % 11 = 0 then -1 else flow end as lab, v from vectors)"


def _labelled(spark, d):
    return vectors(spark, d).withColumn("lab", F.when(F.col("flight_id") % 11 == 0, -1).otherwise(F.col("flow")))


@query(f"""with {VECTORS}, {_LABELS}, l as (select * from labels_ where lab >= 0),
    p as (select a.flight_id as u, a.lab as la, b.lab as lb, avg(sqrt({_DIST})) as m from l a join l b on a.flight_id <> b.flight_id group by 1, 2, 3),
    o as (select u, min(m) filter (la = lb) as i, min(m) filter (la <> lb) as o from p group by u)
    select round(avg(case when i is null then 0 when greatest(i, o) = 0 then 0 else (o - i) / greatest(i, o) end), 6) as silhouette from o where o is not null""")
def silhouette(spark, d):
    return evaluate.silhouette(_labelled(spark, d), [], "flight_id", "lab", "v").select(r("silhouette").alias("silhouette"))


_CENTRES = f"with {VECTORS}, {_LABELS}, l as (select lab, flight_id, i as dim, v[i] as x from labels_, unnest(range(1, 65)) as u(i) where lab >= 0), c as (select lab, dim, count(*) as n, avg(x) as c, var_pop(x) as q from l group by lab, dim)"


@query(_CENTRES + """, g as (select l.lab, flight_id, sqrt(sum(power(x - c, 2))) as g from l join c using (lab, dim) group by l.lab, flight_id), s as (select lab, avg(g) as s from g group by lab),
    m as (select i.lab as li, j.lab as lj, sqrt(sum(power(i.c - j.c, 2))) as m from c i join c j on i.dim = j.dim and i.lab <> j.lab group by 1, 2),
    w as (select li, max((a.s + b.s) / m) as r from m join s a on a.lab = li join s b on b.lab = lj group by li) select round(avg(r), 6) as davies_bouldin from w""")
def davies_bouldin(spark, d):
    f = _labelled(spark, d).withColumn("g", F.lit(0))
    return evaluate.davies_bouldin(f, ["g"], "flight_id", "lab", "v").select(r("davies_bouldin").alias("davies_bouldin"))


@query(_CENTRES + """, g as (select dim, sum(n * c) / sum(n) as g from c group by dim), s as (select sum(n * power(c - g, 2)) as b, sum(n * q) as w, count(distinct lab) as k from c join g using (dim)), n as (select count(distinct flight_id) as n from l)
    select round(b / (k - 1) / (w / (n - k)), 6) as calinski_harabasz from s, n""")
def calinski_harabasz(spark, d):
    f = _labelled(spark, d).withColumn("g", F.lit(0))
    return evaluate.calinski_harabasz(f, ["g"], "flight_id", "lab", "v").select(r("calinski_harabasz").alias("calinski_harabasz"))


@query(f"with {VECTORS}, {_LABELS} select flow, count(*) as n_units, count(*) filter (lab < 0) as n_noise, count(distinct case when lab >= 0 then lab end) as n_clusters, round(count(*) filter (lab < 0) / count(*)::double, 6) as noise_frac from labels_ group by flow")
def noise_share(spark, d):
    return evaluate.noise_share(_labelled(spark, d), ["flow"], "lab").select("flow", "n_units", "n_noise", "n_clusters", r("noise_frac").alias("noise_frac"))


@query(f"""with {VECTORS}, p as (select flow as a, (flight_id % 7)::int as b from vectors), c as (select a, b, count(*) as n from p group by a, b), t as (select sum(n * (n - 1) / 2.0::double) as both_, sum(n)::double as n from c),
    ra as (select sum(n * (n - 1) / 2.0::double) as s from (select sum(n) as n from c group by a)), rb as (select sum(n * (n - 1) / 2.0::double) as s from (select sum(n) as n from c group by b))
    select round((both_ - ra.s * rb.s / (t.n * (t.n - 1) / 2)) / ((ra.s + rb.s) / 2 - ra.s * rb.s / (t.n * (t.n - 1) / 2)), 8) as ari from t, ra, rb""")
def adjusted_rand(spark, d):
    p = vectors(spark, d).select(F.col("flow").alias("a"), (F.col("flight_id") % 7).alias("b"))
    return evaluate.adjusted_rand(p, [], "a", "b").select(r("ari", 8).alias("ari"))


@query(f"""with {_PAIRS}, {_BOTH}, k as (select flow, u, d as kd from both_ qualify row_number() over (partition by u order by d, v) = 4), c as (select *, row_number() over (partition by flow order by kd, u) as place from k),
    e as (select flow, min(place) as x0, max(place) as x1, arg_min(kd, place) as y0, arg_max(kd, place) as y1 from c group by flow),
    g as (select c.flow, kd, place, abs((y1 - y0) * (place - x0) - (x1 - x0) * (kd - y0)) / sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) as gap from c join e using (flow))
    select flow, round(arg_max(kd, (gap, -place)), 6) as eps from g group by flow""")
def knee_eps(spark, d):
    curve = evaluate.k_distance(vectors(spark, d), ["flow"], "flight_id", 4)
    return evaluate.knee(curve, ["flow"]).select("flow", r("eps").alias("eps"))


@query(f"with {_PAIRS}, n as (select flow, count(*) as n from vectors group by flow), e as (select flow, count(*) as e from pairs where d < 1.2 group by flow) select n.flow, round(coalesce(e, 0) / (n * (n - 1) / 2.0::double), 6) as density from n left join e using (flow)")
def edge_density(spark, d):
    near = _pairs(spark, d, within=1.2).where("d < 1.2")
    return evaluate.density(near, vectors(spark, d), ["flow"]).select("flow", r("density").alias("density"))


_EPS, _LEAST = 1.05, 4
@query(f"""with recursive {VECTORS}, p as (select a.flight_id as u, b.flight_id as v from vectors a join vectors b on a.flow = b.flow and a.flight_id <> b.flight_id where sqrt({_DIST}) <= {_EPS}),
    core as (select v.flight_id as u from vectors v left join p on p.u = v.flight_id group by v.flight_id having count(p.v) + 1 >= {_LEAST}),
    ce as (select p.u, p.v from p join core a on a.u = p.u join core b on b.u = p.v),
    reach as (select u, u as root from core union select ce.v, reach.root from reach join ce on ce.u = reach.u), named as (select u, min(root) as cluster from reach group by u),
    border as (select p.u, min(named.cluster) as cluster from p join named on named.u = p.v group by p.u)
    select v.flight_id, coalesce(n.cluster, b.cluster, -1)::bigint as cluster from vectors v left join named n on n.u = v.flight_id left join border b on b.u = v.flight_id""")
def dbscan_distributed(spark, d):
    e = _pairs(spark, d, within=_EPS).select("flight_id_a", "flight_id_b", "d")
    return cluster.dbscan_edges(vectors(spark, d).select("flight_id"), e, "flight_id", _EPS, _LEAST)


@query(f"""with recursive {_PAIRS}, {_BOTH}, {_KNN(2)}, g as (select a_id as u, b_id as v from edges union select b_id, a_id from edges),
    reach as (select distinct u, u as root from g union select g.v, reach.root from reach join g on g.u = reach.u) select u as flight_id, min(root) as component from reach group by u""")
def knn_components(spark, d):
    e = _edges(spark, d, 2).select(F.col("flight_id_a").alias("u"), F.col("flight_id_b").alias("v"))
    return components(e).select(F.col("node").alias("flight_id"), F.col("root").alias("component"))


def _flows(name, **params):
    def run(spark, d):
        return cluster.cluster_flows(vectors(spark, d), ["flow"], "flight_id", "v", name, **params)

    run.__name__ = f"cluster_{name}"
    return query(_BY_FIRST if name == "dbscan" else None)(run)


_DBSCAN = ORACLE_SQL["dbscan_distributed"]
_AT = _DBSCAN.rindex("select v.flight_id, coalesce")
#: The same clusters, numbered within their flow by their first unit.
_BY_FIRST = f"""{_DBSCAN[:_AT].rstrip()}, found as (select v.flow, {_DBSCAN[_AT:].lstrip().removeprefix("select ")}),
    firsts as (select flow, cluster, row_number() over (partition by flow order by min(flight_id)) - 1 as number from found where cluster >= 0 group by flow, cluster)
    select found.flow, flight_id, coalesce(number, -1)::int as cluster_id from found left join firsts using (flow, cluster)"""


for _name, _params in (
    ("kmeans", {"n_clusters": 3}),
    ("minibatch_kmeans", {"n_clusters": 3}),
    ("dbscan", {"eps": _EPS, "min_samples": _LEAST}),
    ("optics", {"min_samples": 4, "xi": 0.02}),
    ("hdbscan", {"min_cluster_size": 4, "min_samples": 3}),
    ("agglomerative", {"n_clusters": 3, "linkage": "average"}),
    ("birch", {"n_clusters": 3, "threshold": 0.6}),
    ("spectral", {"n_clusters": 3}),
    ("gmm", {"n_components": 2}),
    ("meanshift", {}),
    ("affinity_propagation", {}),
    ("two_stage", {"first": "kmeans", "second": "hdbscan", "first_params": {"n_clusters": 2}, "second_params": {"min_cluster_size": 3, "min_samples": 2}}),
):
    _flows(_name, **_params)


@query(f"with {TRACKS}, p as (select flow, step, unnest([10, 50, 90])::int as percentile, unnest(quantile_cont(x, [0.1, 0.5, 0.9])) as x, unnest(quantile_cont(y, [0.1, 0.5, 0.9])) as y from tracks group by flow, step), n as (select flow, count(distinct flight_id) as n_flights from tracks group by flow) select flow, step, percentile, round(x, 6) + 0.0 as x, round(y, 6) + 0.0 as y, n_flights from p join n using (flow)")
def backbone_percentiles(spark, d):
    b = side.backbones(tracks(spark, d), ["flow"], "flight_id", ["x", "y"])
    return b.select("flow", "step", "percentile", r("x").alias("x"), r("y").alias("y"), "n_flights")


_LINE = f"with {TRACKS}, line as (select flow, step, median(x) as x, median(y) as y from tracks group by flow, step)"
_TANGENT = """, g as (select *, coalesce(lead(x) over w, x) - coalesce(lag(x) over w, x) as dx, coalesce(lead(y) over w, y) - coalesce(lag(y) over w, y) as dy from line window w as (partition by flow order by step)),
    n as (select *, -dy / case when sqrt(dx * dx + dy * dy) = 0 then 1 else sqrt(dx * dx + dy * dy) end as nx, dx / case when sqrt(dx * dx + dy * dy) = 0 then 1 else sqrt(dx * dx + dy * dy) end as ny from g)"""


@query(_LINE + _TANGENT + " select t.flow, t.flight_id, t.step, round((t.x - n.x) * nx + (t.y - n.y) * ny, 6) + 0.0 as offset_m from tracks t join n using (flow, step)")
def lateral_offsets(spark, d):
    t = tracks(spark, d)
    line = t.groupBy("flow", "step").agg(F.median("x").alias("x"), F.median("y").alias("y"))
    return side.lateral_offsets(t, line, ["flow"], "x", "y").select("flow", "flight_id", "step", r("offset").alias("offset_m"))


_T = ", ".join(f"('{n}', {k}::double, {w}::double)" for n, k, w in side.TRACKS)


@query(_LINE + _TANGENT + f""", s as (select t.flow, stddev_samp((t.x - n.x) * nx + (t.y - n.y) * ny) as sigma from tracks t join n using (flow, step) group by t.flow), k as (select * from (values {_T}) as v(track, k, weight))
    select n.flow, n.step, track, weight, round(x + k * sigma * nx, 6) + 0.0 as x, round(y + k * sigma * ny, 6) + 0.0 as y from n join s using (flow), k""")
def side_tracks(spark, d):
    return side.side_tracks(tracks(spark, d), ["flow"], "x", "y").select("flow", "step", "track", "weight", r("x").alias("x"), r("y").alias("y"))


@query(f"""with {VECTORS}, f as (select flow, count(*) as total from vectors group by flow), k as (select * from (values {_T}) as v(track, k, weight)),
    c as (select flow, total, track, round_even(total * weight, 0)::bigint as n from f, k), s as (select flow, total - sum(n) as rest from c group by flow, total)
    select flow, track, greatest(n + case when track = 'centre' then rest else 0 end, 0)::bigint as n_flights from c join s using (flow)""")
def track_flight_counts(spark, d):
    f = vectors(spark, d).groupBy("flow").agg(F.count(F.lit(1)).alias("total"))
    return side.track_counts(f, ["flow"], "total")


@query(_LINE + """, p as (select *, lag(x) over w as px, lag(y) over w as py, lead(x) over w as nx, lead(y) over w as ny from line window w as (partition by flow order by step)),
    c as (select *, (x - px) * (ny - y) - (y - py) * (nx - x) as z from p)
    select flow, step, case when z <> 0 then round(sqrt(power(x - px, 2) + power(y - py, 2)) * sqrt(power(nx - x, 2) + power(ny - y, 2)) * sqrt(power(nx - px, 2) + power(ny - py, 2)) / (2 * abs(z)), 5) end as radius, case when z > 0 then 'l' when z < 0 then 'r' else 's' end as turn from c""")
def turn_radius(spark, d):
    line = tracks(spark, d).groupBy("flow", "step").agg(F.median("x").alias("x"), F.median("y").alias("y"))
    return side.turns(line, ["flow"], "x", "y").select("flow", "step", r("radius", 5).alias("radius"), "turn")


@query()
def ground_tracks(spark, d):
    line = tracks(spark, d).groupBy("flow", "step").agg(F.median("x").alias("x"), F.median("y").alias("y"))
    g = side.ground_tracks(line.withColumns({"x": F.col("x") * 1_000, "y": F.col("y") * 1_000}), ["flow"], "x", "y", start=(0.0, 0.0))
    return g.select("flow", "step", r("x", 4).alias("x"), r("y", 4).alias("y"), r("s", 4).alias("s"))


@query(f"with {TRACKS}, l as (select *, coalesce(sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)), 0) as seg from tracks window w as (partition by flight_id order by step)), f as (select flow, flight_id, sum(seg) as length from l group by flow, flight_id) select flow, count(*) as n, round(avg(length), 6) as mean_length, round(quantile_cont(length, 0.05), 6) as p5, round(quantile_cont(length, 0.95), 6) as p95 from f group by flow")
def track_lengths(spark, d):
    s = signal.chainage(tracks(spark, d), ["flow", "flight_id"], ["step"], "x", "y")
    f = s.groupBy("flow", "flight_id").agg(F.sum("seg").alias("length"))
    return f.groupBy("flow").agg(F.count(F.lit(1)).alias("n"), r(F.avg("length")).alias("mean_length"), r(F.percentile("length", F.lit(0.05))).alias("p5"), r(F.percentile("length", F.lit(0.95))).alias("p95"))


@query(f"with {TRACKS}, s as (select flow, step, sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)) as seg from tracks window w as (partition by flight_id order by step)) select flow, step, count(seg) as n, round(avg(seg), 6) as mean, round(stddev_pop(seg), 6) as std, round(median(seg), 6) as p50 from s where step > 0 group by flow, step")
def flow_step_profile(spark, d):
    s = signal.chainage(tracks(spark, d), ["flow", "flight_id"], ["step"], "x", "y").where("step > 0")
    p = stats.spread(s, ["flow", "step"], "seg", (0.5,))
    return p.select("flow", "step", "n", r("mean").alias("mean"), r("std").alias("std"), r("p50").alias("p50"))


@query(f"""with {TRACKS}, {_PAIRS.removeprefix(VECTORS + ", ")}""".replace("with tracks", f"with {VECTORS}, tracks") + f""", {_BOTH}, {_KNN(5)},
    l as (select *, coalesce(sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)), 0) as seg from tracks window w as (partition by flight_id order by step)),
    h as (select *, sum(seg) over (partition by flight_id order by step) as s from l),
    g as (select flight_id, list(x order by step) as xs, list(y order by step) as ys, list(s order by step) as s from h group by flight_id),
    t as (select *, case when k = 31 then s[32] else s[1] + (s[32] - s[1]) * k / 31.0::double end as here from g, unnest(range(0, 32)) as u(k)),
    i as (select *, greatest(len(list_filter(s, lambda z: z <= here)), 1) as i from t), j as (select *, least(i + 1, 32) as j from i),
    p as (select flight_id, k, xs[i] + case when s[j] > s[i] then (xs[j] - xs[i]) * (here - s[i]) / (s[j] - s[i]) else 0 end as x, ys[i] + case when s[j] > s[i] then (ys[j] - ys[i]) * (here - s[i]) / (s[j] - s[i]) else 0 end as y from j),
    c as (select e.flow, a_id, b_id, e.d / (sqrt(sum(power(a.x - b.x, 2) + power(a.y - b.y, 2))) + 1e-9) as ratio from edges e join p a on a.flight_id = a_id join p b on b.flight_id = b_id and a.k = b.k group by e.flow, a_id, b_id, e.d)
    select flow, count(*) as n, round(avg(ratio), 6) as mean_ratio, round(median(ratio), 6) as median_ratio, round(quantile_cont(ratio, 0.9), 6) as p90_ratio, round(quantile_cont(ratio, 0.95), 6) as p95_ratio from c group by flow""")
def inflation_ratio(spark, d):
    """Distance over the index against distance over arc length, for candidate pairs."""
    t = resample.collect_tracks(signal.chainage(tracks(spark, d), ["flow", "flight_id"], ["step"], "x", "y"), ["flow", "flight_id"], ["step"], ["x", "y", "s"])
    even = resample.resample(t, ["x", "y"], 32, "s").select("flight_id", F.flatten(F.zip_with("x", "y", lambda a, b: F.array(a, b))).alias("arc"))
    e = _edge_tracks(spark, d).withColumn("plain", arrays.euclid(F.col("v_a"), F.col("v_b")))
    j = e.join(even.select(F.col("flight_id").alias("flight_id_a"), F.col("arc").alias("a")), "flight_id_a").join(even.select(F.col("flight_id").alias("flight_id_b"), F.col("arc").alias("b")), "flight_id_b")
    ratio = F.col("plain") / (arrays.euclid(F.col("a"), F.col("b")) + 1e-9)
    out = [F.avg(ratio).alias("mean_ratio"), F.median(ratio).alias("median_ratio"), F.percentile(ratio, F.lit(0.9)).alias("p90_ratio"), F.percentile(ratio, F.lit(0.95)).alias("p95_ratio")]
    return j.groupBy("flow").agg(F.count(F.lit(1)).alias("n"), *out).select("flow", "n", *[r(c).alias(c) for c in ("mean_ratio", "median_ratio", "p90_ratio", "p95_ratio")])
