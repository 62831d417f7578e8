"""Queries over plain tables: counts, profiles, outliers, ranks, levels, fields and coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, idents, timeops
from ..operators import joins, stats, tracks
from .registry import query, r, table


@query("""
    select (case when grouping(o_orderpriority) = 1 then 0 when grouping(o_orderstatus) = 1 then 1 else 2 end)::int as grouping, o_orderstatus, o_orderpriority,
           count(distinct o_custkey) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority))
""")
def grouping_sets_counts(spark, d):
    return stats.marginals(table(spark, d, "orders"), [["o_orderstatus"], ["o_orderpriority"], ["o_orderstatus", "o_orderpriority"]], "o_custkey")


@query("select c_mktsegment, count(*) as n, round(100 * count(*) / sum(count(*)) over (), 3) as pct from customer group by c_mktsegment")
def group_shares(spark, d):
    return stats.counts(table(spark, d, "customer"), ["c_mktsegment"])


@query("""
    with p as (select l_partkey, l_orderkey, l_linenumber, l_quantity as a, l_tax * 100 as b from lineitem),
    c as (select l_partkey, median(a) as ma, median(b) as mb from p group by l_partkey),
    e as (select p.*, sqrt((a - ma) * (a - ma) + (b - mb) * (b - mb)) as distance from p join c using (l_partkey)),
    m as (select l_partkey, median(distance) as med from e group by l_partkey),
    s as (select l_partkey, any_value(med) as med, median(abs(distance - med)) as mad from e join m using (l_partkey) group by l_partkey)
    select l_partkey, count(*) as n, count(*) filter (distance > med + 4.4478 * mad + 1e-9) as n_out, round(max(distance), 5) as worst, round(any_value(med + 4.4478 * mad), 5) as lim
    from e join s using (l_partkey) group by l_partkey
""")
def robust_outliers(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", F.col("l_quantity").alias("a"), (F.col("l_tax") * 100).alias("b"))
    marked = stats.robust_outliers(rows, ["l_partkey"], ["a", "b"])
    return marked.groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("outlier") & (F.col("distance") > F.col("limit") + 1e-9)).alias("n_out"),
        r(F.max("distance"), 5).alias("worst"),
        r(F.first("limit"), 5).alias("lim"),
    )


@query("""
    select event_type, count(value) as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, min(value) as min, max(value) as max,
           round(quantile_cont(value, 0.05), 6) as p5, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from events group by event_type
""")
def value_spread(spark, d):
    s = stats.spread(table(spark, d, "events"), ["event_type"], "value")
    return s.select("event_type", "n", "min", "max", *[r(c).alias(c) for c in ("mean", "std", "p5", "p50", "p95")])


@query("""
    select strftime(o_orderdate, '%Y-%m') as month, count(*) as n_rows, count(distinct o_custkey) as n_ids, strftime(min(o_orderdate), '%Y-%m-%d') as first_ts,
        strftime(max(o_orderdate), '%Y-%m-%d') as last_ts, min(o_totalprice) as low, max(o_totalprice) as high, 100.0 * count(*) filter (o_custkey is null) / count(*) as missing,
        round(quantile_cont(o_totalprice, 0.5), 6) as p50, count(*) filter (o_totalprice < 1000 or o_totalprice > 400000) as odd from orders group by 1
""")
def monthly_profile(spark, d):
    o = table(spark, d, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    o = o.withColumns({"lat": F.col("o_totalprice"), "lon": F.col("o_totalprice"), "alt": F.col("o_totalprice")})
    p = stats.profile(o, ["month"], "o_custkey", "o_orderdate", "lat", "lon", "alt", {"alt": (1_000, 400_000)})
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return p.select(
        "month", "n_rows", "n_ids", day("first_ts"), day("last_ts"), F.col("min_lat").alias("low"), F.col("max_lat").alias("high"),
        F.col("missing_o_custkey").alias("missing"), r("p50_alt").alias("p50"), F.col("odd_alt").alias("odd"),
    )


@query("select event_type, least(floor((value - 0) * 20 / 200), 19)::bigint as bin, count(*) as n from events where value between 0 and 200 group by all")
def hist_bins(spark, d):
    return stats.histogram(table(spark, d, "events"), ["event_type"], "value", 0.0, 200.0, 20)


@query("select event_type, value, max(share) as share from (select event_type, value, round(cume_dist() over (partition by event_type order by value), 9) as share from events where value is not null) group by all")
def ecdf(spark, d):
    return stats.ecdf(table(spark, d, "events"), ["event_type"], "value").select("event_type", "value", r("share", 9).alias("share"))


@query("""
    with k as (select l_returnflag, l_quantity as a, l_extendedprice as b,
                      rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2 as ra,
                      rank() over (partition by l_returnflag order by l_extendedprice) + (count(*) over (partition by l_returnflag, l_extendedprice) - 1) / 2 as rb from lineitem)
    select l_returnflag, count(*) as n, round(corr(a, b), 6) as pearson, round(corr(ra, rb), 6) as spearman from k group by l_returnflag
""")
def pearson_spearman(spark, d):
    c = stats.correlations(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return c.select("l_returnflag", "n", r("pearson").alias("pearson"), r("spearman").alias("spearman"))


def _levels(spark, d, where: str = "true"):
    return table(spark, d, "lineitem").where(where).select("l_suppkey", F.col("l_quantity").alias("level_db"))


@query("select l_suppkey, round(10 * log10(greatest(sum(pow(10, l_quantity / 10)), 1e-12)), 6) as level_db from lineitem group by l_suppkey")
def energy_sum_db(spark, d):
    return tracks.total_levels(_levels(spark, d), ["l_suppkey"], "level_db").select("l_suppkey", r("level_db").alias("level_db"))


@query("""
    with p as (select l_suppkey, 10 * log10(sum(pow(10, l_quantity / 10))) as l from lineitem where l_returnflag = 'A' group by 1),
    f as (select l_suppkey, 10 * log10(sum(pow(10, l_quantity / 10))) as l from lineitem group by 1),
    j as (select l_suppkey, p.l - f.l as delta from p join f using (l_suppkey))
    select count(*) as n_points, round(avg(abs(delta)), 6) as mae, round(avg(delta * delta), 6) as mse, round(max(abs(delta)), 6) as max_abs from j
""")
def level_errors(spark, d):
    part, whole = (tracks.total_levels(_levels(spark, d, w), ["l_suppkey"], "level_db") for w in ("l_returnflag = 'A'", "true"))
    return tracks.compare_levels(part, whole, ["l_suppkey"], "level_db").select("n_points", *[r(c).alias(c) for c in ("mae", "mse", "max_abs")])


@query("select l_suppkey, round(sum(l_quantity), 6) as v from (select l_suppkey, l_quantity from lineitem where l_returnflag = 'A' union all select l_suppkey, l_quantity from lineitem where l_returnflag = 'R') group by 1")
def accumulated_batches(spark, d):
    frames = [_levels(spark, d, f"l_returnflag = '{x}'").withColumnRenamed("level_db", "v") for x in ("A", "R")]
    return joins.accumulate(frames, ["l_suppkey"], "v").withColumn("v", r("v"))


@query("""
    with m as (select l_suppkey, avg(l_quantity) as s, avg(l_discount) as b, avg(l_extendedprice) as c, avg((l_returnflag = 'R')::int) as n from lineitem group by 1),
    z as (select l_suppkey, {}) select l_suppkey, round(0.35 * zs - 0.25 * zb + 0.25 * zc - 0.15 * zn, 6) as score from z
""".replace("{}", ", ".join(f"case when stddev_pop({x}) over () > 0 then ({x} - avg({x}) over ()) / stddev_pop({x}) over () else 0 end as z{x}" for x in "sbcn") + " from m"))
def rank_composite(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.avg("l_quantity").alias("s"), F.avg("l_discount").alias("b"), F.avg("l_extendedprice").alias("c"), F.avg((F.col("l_returnflag") == "R").cast("int")).alias("n")
    )
    return stats.composite(m, "s", "b", "c", "n").select("l_suppkey", r("score").alias("score"))


@query("""
    with n as (select vec_id % 3 as flow, label - 1 as c, count(*) as n from embeddings group by all)
    select flow, string_agg(c || '=' || n, ' / ' order by c) filter (c >= 0) || ' + ' || sum(n) filter (c < 0) || ' noise' as signature from n group by flow
""")
def cluster_signature(spark, d):
    return stats.signature(table(spark, d, "embeddings").select((F.col("vec_id") % 3).alias("flow"), (F.col("label") - 1).alias("c")), ["flow"], "c")


@query("""
    with g as (select c_nationkey, c_mktsegment, count(*) as n from customer group by all)
    select * exclude k from (select *, row_number() over (partition by c_nationkey order by n desc, c_mktsegment) as k from g) where k = 1
""")
def modal_type(spark, d):
    return stats.modal(table(spark, d, "customer"), ["c_nationkey"], "c_mktsegment")


@query("select min(n) as least, median(n) as median, max(n) as most, min(n) = max(n) as constant from (select count(*) as n from events group by user_id)")
def points_per_flight(spark, d):
    return stats.points_per_flight(table(spark, d, "events"), "user_id")


@query("select case when quantile_cont(value, 0.99) > 350 then 'kt' else 'm/s' end as speed_unit, case when quantile_cont(value * 100, 0.95) > 20000 then 'ft' else 'm' end as altitude_unit from events")
def unit_inference(spark, d):
    return stats.units(table(spark, d, "events").withColumn("alt", F.col("value") * 100), "value", "alt")


@query("select o_orderpriority, round(sum(o_totalprice * (o_custkey % 5)) / sum(o_custkey % 5), 5) as mean from orders where o_custkey % 5 > 0 group by 1")
def weighted_metric_means(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(r(stats.weighted_mean(F.col("o_totalprice"), F.col("o_custkey") % 5), 5).alias("mean"))


@query("""
    select event_id, case when event_id % 7 = 0 then null else upper(event_type) end as ident, 'M' || lpad((event_id % 12)::varchar, 2, '0') as mp, round(value, 3) as level,
           case event_id % 3 when 0 then true when 1 then false end as flag, event_type || '_' || user_id as flow from events
""")
def normalised_fields(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id")
    raw = F.when(k % 7 == 0, F.lit(" nan ")).otherwise(F.concat(F.lit(" "), "event_type"))
    flag = F.when(k % 3 == 0, "yes").when(k % 3 == 1, "0.0").otherwise("?")
    return e.select(
        "event_id", idents.normalise(raw).alias("ident"), idents.microphone(F.concat(F.lit("mp "), (k % 12).cast("string"))).alias("mp"),
        r(idents.decimal_comma(F.translate(F.col("value").cast("string"), ".", ",")), 3).alias("level"), idents.parse_bool(flag).alias("flag"), idents.flow_label(F.col("event_type"), F.col("user_id")).alias("flow"),
    )


@query("select c_custkey, round(51 + (c_custkey % 300) / 100.0, 6) as lat, round(7 + (c_custkey % 490) / 100.0, 6) as lon from customer")
def utm_round_trip(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (51 + F.col("c_custkey") % 300 / 100).alias("lat"), (7 + F.col("c_custkey") % 490 / 100).alias("lon"))
    x, y = geo.utm("lat", "lon")
    lat, lon = geo.lat_lon("x", "y")
    return c.select("c_custkey", x.alias("x"), y.alias("y")).select("c_custkey", r(lat).alias("lat"), r(lon).alias("lon"))


@query("select o_orderkey, (case when month(o_orderdate) * 100 + day(o_orderdate) between 328 and 1030 then 2 else 1 end)::int as hours from orders")
def season_offsets(spark, d):
    return table(spark, d, "orders").select("o_orderkey", timeops.season_offset_hours(F.col("o_orderdate")).alias("hours"))


@query("select vec_id, label, event_type, user_id from embeddings join events on event_id = vec_id")
def labels_with_metadata(spark, d):
    points = table(spark, d, "events").withColumnRenamed("event_id", "vec_id")
    return joins.with_metadata(table(spark, d, "embeddings").select("vec_id", "label"), points, "vec_id", "ts", ["event_type", "user_id"])
