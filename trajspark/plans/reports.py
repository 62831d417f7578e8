"""Queries of reports, filters and look-ups of whole flights, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flights, ranks, reports, tracks
from .registry import STREAM, VECTORS, query, r, stream, table, vectors


@query(f"""with {STREAM}, k as (select *, row_number() over (partition by flow order by dist, event_id) as lo, row_number() over (partition by flow order by dist desc, event_id) as hi from stream)
    select a.flow, a.dist as min_dist, a.ident as ident_at_min_dist, b.dist as max_dist, b.ident as ident_at_max_dist from k a join k b on a.flow = b.flow and a.lo = 1 and b.hi = 1""")
def arg_extremes(spark, d):
    return reports.arg_extremes(stream(spark, d), ["flow"], ["dist"], ["ident"], "event_id")


@query("""with v as (select l_suppkey, l_returnflag, avg(l_extendedprice) as v from lineitem group by all)
    select l_suppkey, count(*) as n, round(min(v), 5) as min, round(max(v), 5) as max, round(avg(v), 5) as mean, round(stddev_samp(v), 5) as std, round(max(v) - min(v), 5) as range from v group by l_suppkey""")
def receiver_variation(spark, d):
    v = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_extendedprice").alias("v"))
    return reports.variation(v, "l_suppkey", "v").select("l_suppkey", "n", *[r(c, 5).alias(c) for c in ("min", "max", "mean", "std", "range")])


_ROWS = "select '{0}' as unit, count(*) as units, round(avg(n), 6) as mean, round(quantile_cont(n, 0.05), 6) as p5, round(median(n), 6) as median, round(quantile_cont(n, 0.95), 6) as p95 from (select count(*) as n from stream group by {1})"


@query(f"with {STREAM} {_ROWS.format('day', 'ts::date')} union all {_ROWS.format('flight', 'ident')}")
def rows_per_day_and_flight(spark, d):
    s = stream(spark, d)
    each = [reports.rows_per(s, u).select(F.lit(n).alias("unit"), "units", *[r(c).alias(c) for c in ("mean", "p5", "median", "p95")]) for n, u in (("day", F.to_date("ts")), ("flight", F.col("ident")))]
    return each[0].unionByName(each[1])


@query(f"""with {STREAM}, e as (select flow, ident, avg(dist) - 50 as err, count(*) as n from stream group by all), g as (select flow, sum(n)::bigint as n_flights, sum(err * n) / sum(n) as bias, sum(abs(err) * n) / sum(n) as mae, sum(err * err * n) / sum(n) as mse from e group by flow)
    select flow, n_flights, round(bias, 6) as bias, round(mae, 6) as mae, round(mse, 6) as mse, round(n_flights / sum(n_flights) over (), 6) as share from g""")
def error_per_flow(spark, d):
    e = stream(spark, d).groupBy("flow", "ident").agg((F.avg("dist") - 50).alias("err"), F.count(F.lit(1)).alias("n"))
    return reports.error_per_flow(e, ["flow"], "err", "n").select("flow", "n_flights", *[r(c).alias(c) for c in ("bias", "mae", "mse", "share")])


@query("""with k as (select *, row_number() over (partition by p_brand order by p_retailprice, p_name) as lo, row_number() over (partition by p_brand order by p_retailprice desc, p_name) as hi from part where p_retailprice is not null)
    select p_brand, count(*) as n, round(avg(p_retailprice), 6) as mean, max(p_name) filter (lo = 1) as best, min(p_retailprice) as best_value, max(p_name) filter (hi = 1) as worst, max(p_retailprice) as worst_value from k group by p_brand""")
def best_and_worst(spark, d):
    return reports.best_and_worst(table(spark, d, "part"), ["p_brand"], "p_name", "p_retailprice").withColumn("mean", r("mean"))


_LABELS = f"{VECTORS}, lab as (select flight_id % 3 as experiment, flow, flight_id, case when flight_id % 11 = 0 then -1 else (flight_id // 3) % (1 + flow % 3) end as cluster from vectors)"


def _labels(spark, d):
    i = F.col("flight_id")
    return vectors(spark, d).select((i % 3).alias("experiment"), "flow", "flight_id", F.when(i % 11 == 0, -1).otherwise(F.floor(i / 3) % (1 + F.col("flow") % 3)).cast("long").alias("cluster"))


@query(f"""with {_LABELS}, p as (select experiment, flow, count(*) as n, count(*) filter (cluster < 0) as noise, count(distinct case when cluster >= 0 then cluster end) as k from lab group by all)
    select experiment, sum(n)::bigint as n_units, sum(noise)::bigint as n_noise, count(*) as n_flows, sum(k)::bigint as n_clusters, round(avg(k), 6) as clusters_per_flow, max(k) as most_clusters, count(*) filter (k > 1) as n_split_flows from p group by experiment""")
def label_summary(spark, d):
    return reports.label_summary(_labels(spark, d), ["experiment"], ["flow"], "cluster").withColumn("clusters_per_flow", r("clusters_per_flow"))


@query(f"with {_LABELS} select flow, count(*) as n_labels, count(*) filter (cluster >= 0) as n_counted, count(*) filter (cluster < 0) = 0 as agrees from lab group by flow")
def count_integrity(spark, d):
    lab = _labels(spark, d)
    counts = lab.where("cluster >= 0").groupBy("flow", "cluster").agg(F.count(F.lit(1)).alias("n_flights"))
    return reports.counts_agree(lab, counts, ["flow"])


@query("select s_suppkey, s_acctbal, rank() over (order by s_acctbal desc) as rank from supplier where s_acctbal is not null union all select s_suppkey, s_acctbal, null from supplier where s_acctbal is null")
def ranked_results(spark, d):
    return reports.ranked_results(table(spark, d, "supplier"), "s_suppkey", "s_acctbal", descending=True)


_Z = lambda c: f"case when stddev_pop({c}) over () > 0 then ({c} - avg({c}) over ()) / stddev_pop({c}) over () else 0 end"
_METRICS = "select p_brand as method, p_type, count(*) as n, avg(p_retailprice) as sil, avg(p_size) as db, sum(p_retailprice) as ch, min(p_size) as noise from part group by all"


@query(f"""with m as ({_METRICS}), s as (select method, p_type as name, n > 2 as eligible, 0.35 * {_Z('sil')} - 0.25 * {_Z('db')} + 0.25 * {_Z('ch')} - 0.15 * {_Z('noise')} as score from m)
    select method, name, round(score, 5) as score, eligible from s qualify row_number() over (partition by method order by eligible desc, score desc, name) = 1""")
def method_winners(spark, d):
    m = table(spark, d, "part").groupBy(F.col("p_brand").alias("method"), F.col("p_type").alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("sil"), F.avg("p_size").alias("db"), F.sum("p_retailprice").alias("ch"), F.min("p_size").alias("noise")
    )
    return reports.winners(m, "method", "name", F.col("n") > 2, ("sil", "db", "ch", "noise")).withColumn("score", r("score", 5))


_EXP = "select o_orderpriority as experiment, o_orderstatus as flow, count(*) as n_units, avg(o_totalprice) as price, stddev_pop(o_totalprice) as dev from orders group by all"


@query(f"""with m as ({_EXP}), u as (select experiment, 'overall' as scope, null as flow, sum(n_units)::bigint as n_units, sum(price * n_units) / sum(n_units) as price, sum(dev * n_units) / sum(n_units) as dev from m group by experiment
    union all select experiment, 'flow', flow, n_units, price, dev from m) select experiment, scope, flow, n_units, round(price, 4) as price, round(dev, 4) as dev from u""")
def master_table(spark, d):
    m = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("experiment"), F.col("o_orderstatus").alias("flow")).agg(
        F.count(F.lit(1)).alias("n_units"), F.avg("o_totalprice").alias("price"), F.stddev_pop("o_totalprice").alias("dev")
    )
    return reports.master(m, "experiment", ["flow"], ["price", "dev"], "n_units").withColumns({"price": r("price", 4), "dev": r("dev", 4)})


@query("""with a as (select l_partkey, avg(l_quantity) as q, count(*) as n from lineitem where l_returnflag = 'A' group by 1), b as (select l_partkey, avg(l_quantity) as q, count(*) as n from lineitem where l_returnflag = 'R' group by 1),
    j as (select a.l_partkey as x, b.l_partkey as y, abs(a.q - b.q) as dq, abs(a.n - b.n)::double as dn from a full join b using (l_partkey))
    select count(*) filter (x is not null and y is not null) as "both", count(*) filter (y is null) as left_only, count(*) filter (x is null) as right_only,
           round(max(dq), 6) as max_q, round(max(dn), 6) as max_n, round(quantile_cont(dq, 0.95), 6) as p95_q, round(quantile_cont(dn, 0.95), 6) as p95_n from j""")
def metadata_audit(spark, d):
    of = lambda f: table(spark, d, "lineitem").where(F.col("l_returnflag") == f).groupBy("l_partkey").agg(F.avg("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
    a = reports.audit(of("A"), of("R"), ["l_partkey"], ["q", "n"])
    return a.select("both", "left_only", "right_only", *[r(c).alias(c) for c in ("max_q", "max_n", "p95_q", "p95_n")])


@query("""with o as (select o_custkey, count(*) as n_orders, max(o_totalprice) as most from orders where o_orderpriority = '1-URGENT' group by 1)
    select c_custkey, n_orders, most, case when o_custkey is null then 'missing' else 'done' end as status from customer left join o on o_custkey = c_custkey""")
def status_roll_up(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_totalprice").alias("most"))
    return reports.status(table(spark, d, "customer").select("c_custkey"), o, "c_custkey", {"n_orders": F.col("n_orders"), "most": F.col("most")})


_CORR = " union all ".join(
    f"select '{s}' as scope, '{f}' as feature, '{t}' as target, count(*) as n, round(corr({f}, {t}), 6) as pearson from lineitem where {w}"
    for s, w in (("all", "true"), ("returned", "l_returnflag = 'R'")) for f in ("l_quantity", "l_discount") for t in ("l_extendedprice", "l_tax")
)


@query(_CORR)
def correlation_matrix(spark, d):
    scopes = {"all": F.lit(True), "returned": F.col("l_returnflag") == "R"}
    return reports.correlation_matrix(table(spark, d, "lineitem"), scopes, ["l_quantity", "l_discount"], ["l_extendedprice", "l_tax"]).withColumn("pearson", r("pearson"))


_ENDS = f"""{STREAM}, ends as (select flow, ident, arg_min(dist, (t, event_id)) as fx, arg_min(k, (t, event_id)) as fy, arg_max(dist, (t, event_id)) as lx, arg_max(k, (t, event_id)) as ly from stream group by all),
    c as (select flow, median(fx) as fx, median(fy) as fy, median(lx) as lx, median(ly) as ly from ends group by flow),
    g as (select e.flow, ident, sqrt(power(e.fx - c.fx, 2) + power(e.fy - c.fy, 2)) as a, sqrt(power(e.lx - c.lx, 2) + power(e.ly - c.ly, 2)) as b from ends e join c using (flow)),
    m as (select flow, median(a) as ma, median(b) as mb from g group by flow), s as (select g.flow, median(abs(a - ma)) as sa, median(abs(b - mb)) as sb from g join m using (flow) group by g.flow),
    o as (select g.flow, ident, a > ma + 0.8 * 1.4826 * sa as start_out, b > mb + 0.8 * 1.4826 * sb as anchor_out from g join m using (flow) join s using (flow))"""
_MODE = {"start": "start_out", "anchor": "anchor_out", "both": "start_out and anchor_out", "either": "start_out or anchor_out"}


@query(f"with {_ENDS} " + " union all ".join(f"select '{m}' as mode, flow, count(*) as n_points from stream semi join (select flow, ident from o where not ({w})) k using (flow, ident) group by flow" for m, w in _MODE.items()))
def endpoint_outlier_filter(spark, d):
    s = stream(spark, d)
    out = [flights.drop_endpoint_outliers(s, ["flow"], "ident", ["t", "event_id"], ("dist", "k"), m, 0.8).groupBy("flow").agg(F.count(F.lit(1)).alias("n_points")).select(F.lit(m).alias("mode"), "flow", "n_points") for m in flights.MODES]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(f"with {STREAM}, f as (select ident, arg_min(coalesce(k % 2 = 0, false), (t, event_id)) as m from stream group by ident) select case when m then 'matched' else 'unmatched' end as want, count(*) as n_points from stream join f using (ident) group by 1")
def match_filter(spark, d):
    s = stream(spark, d)
    out = [flights.match_filter(s, "ident", ["t", "event_id"], F.col("k") % 2 == 0, w).agg(F.count(F.lit(1)).alias("n_points")).select(F.lit(w).alias("want"), "n_points") for w in ("matched", "unmatched")]
    return out[0].unionByName(out[1])


@query(f"""with {STREAM}, g as (select ident, flow, arg_min(dist, (t, event_id)) as a, arg_max(dist, (t, event_id)) as b, min(t) as f, max(t) as l from stream where dist is not null group by all)
    select ident, flow, case when b < a then 'A' else 'D' end as direction, case when b < a then l else f end as runway_time from g""")
def direction_heuristic(spark, d):
    return flights.direction(stream(spark, d), ["ident", "flow"], "t", "dist", ["event_id"])


@query(f"with {STREAM}, w as (select ident, min(event_id) as event_id from stream where ident % 5 = 0 and k = 3 group by ident) select s.ident, s.event_id, s.dist from stream s join w using (ident, event_id)")
def flight_by_identity(spark, d):
    s = stream(spark, d)
    wanted = s.where("ident % 5 = 0 and k = 3").select("ident").distinct()
    return flights.by_identity(s.where("k = 3"), ["ident"], wanted, "event_id").select("ident", "event_id", "dist")


@query(f"""with {STREAM}, a as (select ident, flow, avg(dist) as x, avg(k) as y from stream where event_id % 10 <> 0 group by all), b as (select ident, flow, avg(dist) as x, avg(k) as y from stream where event_id % 7 <> 0 group by all),
    j as (select a.ident as p, b.ident as q, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) as gap from a full join b on a.ident = b.ident and a.flow = b.flow)
    select count(*) filter (p is not null and q is not null) as aligned, count(*) filter (q is null) as left_only, count(*) filter (p is null) as right_only, round(avg(gap), 6) as mean_gap, round(max(gap), 6) as max_gap from j""")
def alignment_errors(spark, d):
    of = lambda m: stream(spark, d).where(F.col("event_id") % m != 0).groupBy("ident", "flow").agg(F.avg("dist").alias("x"), F.avg("k").alias("y"))
    a = flights.alignment_errors(of(10), of(7), ["ident", "flow"], ["x", "y"])
    return a.select("aligned", "left_only", "right_only", r("mean_gap").alias("mean_gap"), r("max_gap").alias("max_gap"))


@query(f"""with {STREAM}, e as (select event_id as eid, t as et, dist as ed, k as ek, case when k % 3 = 0 then null else 'T' || (k % 4) end as want, case when k % 2 = 0 then 'A' end as moves from stream where event_id % 50 = 0),
    types as (select distinct ident, 'T' || (ident % 4) as typecode from stream where ident % 3 <> 0), dirs as (select ident, case when arg_max(dist, t) < arg_min(dist, t) then 'A' else 'D' end as direction from stream group by ident),
    h as (select distinct eid, want, moves, ident from e join stream s on abs(s.t - et) <= 600000000 and abs(s.dist - ed) <= 20)
    select eid, h.ident, typecode, direction from h left join types using (ident) join dirs using (ident) where (typecode is null or want is null or typecode = want) and (moves is null or moves = direction)""")
def near_flights(spark, d):
    s = stream(spark, d)
    k = F.col("k")
    e = s.where("event_id % 50 = 0").select(F.col("event_id").alias("eid"), F.col("ts").alias("ets"), F.col("dist").alias("ed"), F.when(k % 3 != 0, F.concat(F.lit("T"), (k % 4).cast("string"))).alias("want"), F.when(k % 2 == 0, "A").alias("moves"))
    types = s.where("ident % 3 <> 0").select(F.col("ident").cast("string").alias("ident"), F.concat(F.lit("T"), (F.col("ident") % 4).cast("string")).alias("typecode")).distinct()
    points = s.select(F.col("ident").cast("string").alias("ident"), "ts", "dist", F.col("dist").alias("altitude"))
    found = flights.near_flights(e, points, types, "eid", "ets", "ts", 600, F.abs(F.col("dist") - F.col("ed")) <= 20, ("want", "typecode"), "moves", "ident")
    return found.select("eid", F.col("ident").cast("long").alias("ident"), "typecode", "direction")


@query(f"with {STREAM} select flow, ident, event_id, row_number() over (partition by flow order by dist, event_id) as place from stream")
def ordered_places(spark, d):
    """Exact places within a group of any size, by slices."""
    return ranks.ranked_rows(stream(spark, d).select("flow", "ident", "event_id", "dist"), ["flow"], ["dist", "event_id"], "place").drop("dist")


@query(f"with {STREAM} select flow, round(quantile_cont(dist, 0.05), 6) as p5, round(quantile_cont(dist, 0.5), 6) as p50, round(quantile_cont(dist, 0.95), 6) as p95 from stream group by flow")
def group_quantiles(spark, d):
    q = ranks.quantiles(stream(spark, d), ["flow"], "dist", {"p5": 0.05, "p50": 0.5, "p95": 0.95})
    return q.select("flow", *[r(c).alias(c) for c in ("p5", "p50", "p95")])


@query("select n_regionkey, count(*) as n, round(avg(n_nationkey), 6) as mean from nation where n_name is not null and n_regionkey is not null group by 1")
def complete_rows(spark, d):
    n = flights.drop_empty(flights.drop_empty(table(spark, d, "nation")), ["n_name", "n_regionkey"])
    return n.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), r(F.avg("n_nationkey")).alias("mean"))


@query("""with l as (select p_brand as flow, p_size % 4 - 1 as cluster, case when p_partkey % 5 = 0 then 'DEFAULT' else upper(p_type) end as t, case when p_partkey % 2 = 0 then 'A' else 'D' end as d from part),
    n as (select flow, cluster, t, d, count(*) as n_flights from l where cluster >= 0 group by all),
    p as (select distinct upper(p_type) as t, 'A' as d, 'P ' || upper(p_type) as profile from part union all select 'DEFAULT', 'D', 'P D'), c as (select distinct upper(p_type) as t, 'C ' || length(p_type) as spectral_class from part where length(p_type) % 2 = 0 union all select 'DEFAULT', 'C 0')
    select flow, cluster::int as cluster, n.t as aircraft_type, n.d as direction, n_flights, coalesce(p.profile, q.profile) as profile, case when p.profile is not null then 'type' when q.profile is not null then 'default' else 'none' end as profile_from,
           coalesce(c.spectral_class, 'C 0') as spectral_class, case when c.t is not null then 'type' else 'default' end as spectral_class_from
    from n left join p on p.t = n.t and p.d = n.d left join p q on q.t = 'DEFAULT' and q.d = n.d left join c on c.t = n.t""")
def experiment_inputs(spark, d):
    part = table(spark, d, "part")
    key = F.col("p_partkey")
    lab = part.select(F.col("p_brand").alias("flow"), (F.col("p_size") % 4 - 1).alias("cluster"), F.when(key % 5 != 0, F.col("p_type")).alias("type"), F.when(key % 2 == 0, "A").otherwise("D").alias("ad"))
    types = part.select(F.col("p_type").alias("type")).distinct()
    extra = lambda *row: spark.createDataFrame([row], "type string, direction string, profile string")
    profiles = types.select("type", F.lit("A").alias("direction"), F.concat(F.lit("P "), F.upper("type")).alias("profile")).unionByName(extra("default", "D", "P D"))
    classes = types.where(F.length("type") % 2 == 0).select("type", F.concat(F.lit("C "), F.length("type").cast("string")).alias("spectral_class"))
    classes = classes.unionByName(spark.createDataFrame([("default", "C 0")], classes.schema))
    return tracks.experiment_inputs(lab, ["flow"], "cluster", "type", "ad", profiles, classes)
