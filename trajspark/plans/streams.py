"""Queries over point streams: segmentation, sessions, joins in time, filters, smoothing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins, segment, signal, stats
from ..operators.resample import collect_tracks, resample, to_steps
from ..operators.signal import ewm as ewm_array
from ..operators.tracks import backbones
from .registry import STREAM, query, r, stream, table

_AUTOMATON = f"""
    with recursive {STREAM}, s as (select *, row_number() over (partition by flow order by ts, event_id) as rn from stream),
    a as (select flow, event_id, rn, t, dist, null::double as delta, 1::bigint as seq from s where rn = 1
          union all
          select s.flow, s.event_id, s.rn, s.t, s.dist, case when b.cut then null else s.dist - a.dist end,
                 a.seq + case when b.cut then 1 else 0 end
          from a join s on s.flow = a.flow and s.rn = a.rn + 1,
          lateral (select s.t - a.t > 1800000000 or abs(s.dist - a.dist) > 60
                          or coalesce(a.delta <> 0 and s.dist - a.dist <> 0 and sign(a.delta) <> sign(s.dist - a.dist), false) as cut) b)
"""


def _segments(spark, d):
    return segment.segment_flights(stream(spark, d), ["flow"], ["ts", "event_id"], "ts", "dist", gap_s=1800, jump_m=60, dense=False)


@query(_AUTOMATON + "select flow, event_id, seq as flight_seq from a")
def segment_flights(spark, d):
    return _segments(spark, d).select("flow", "event_id", "flight_seq")


@query(f"""
    with {STREAM}, h as (select *, coalesce(t - lag(t) over w > 3600000000, false) or coalesce(ident <> lag(ident) over w, false) as cut from stream window w as (partition by flow order by ts, event_id)),
    s as (select *, sum((cut or rn = 1)::int) over (partition by flow order by ts, event_id) as seq from (select *, row_number() over (partition by flow order by ts, event_id) as rn from h)),
    c as (select *, count(*) over (partition by flow, seq) as n from s),
    k as (select flow, seq, row_number() over (order by flow, seq) - 1 as flight_id from (select distinct flow, seq from c where n >= 2))
    select event_id, k.flight_id::bigint as flight_id from c join k using (flow, seq) where n >= 2
""")
def segment_by_identity(spark, d):
    s = segment.segment_flights(stream(spark, d), ["flow"], ["ts", "event_id"], "ts", identity=["ident"], gap_s=3600, min_points=2)
    return s.select("event_id", "flight_id")


@query(_AUTOMATON + """, p as (select *, row_number() over (partition by flow, seq order by rn) - 1 as step from a),
    q as (select flow, step, count(*) as n, unnest([10, 50, 90])::int as percentile, unnest(quantile_cont(dist, [0.1, 0.5, 0.9])) as dist from p group by flow, step),
    n as (select flow, count(distinct seq) as n_flights from p group by flow)
    select q.flow, q.step::int as step, percentile, round(dist, 6) as dist, n_flights from q join n using (flow)
""")
def flow_backbone(spark, d):
    """Segments of the stream, and the percentiles of their values at each step: the flagship."""
    w = Window.partitionBy("flow", "flight_seq").orderBy("ts", "event_id")
    p = _segments(spark, d).withColumn("step", (F.row_number().over(w) - 1).cast("int"))
    b = backbones(p, ["flow"], "flight_seq", ["dist"])
    return b.select("flow", "step", "percentile", r("dist").alias("dist"), "n_flights")


@query(_AUTOMATON + """, g as (select flow, seq, t, abs(dist - lag(dist) over (partition by flow, seq order by rn)) as leg from a)
    select flow, seq as flight_seq, count(*) as n_points, round(coalesce(sum(leg), 0), 6) as length, (max(t) - min(t))::bigint as duration_us from g group by flow, seq
""")
def flight_lengths(spark, d):
    w = Window.partitionBy("flow", "flight_seq").orderBy("ts", "event_id")
    p = _segments(spark, d).withColumn("leg", F.abs(F.col("dist") - F.lag("dist").over(w)))
    return p.groupBy("flow", "flight_seq").agg(F.count(F.lit(1)).alias("n_points"), r(F.coalesce(F.sum("leg"), F.lit(0.0))).alias("length"), (F.max("t") - F.min("t")).alias("duration_us"))


@query(f"""
    with {STREAM}, e as (select distinct ident, ts, t, flow, ts::date as day from stream),
    g as (select *, coalesce(t - lag(t) over (partition by ident, day order by ts, flow) > 7200000000, true) as new from e),
    c as (select *, sum(new::int) over (partition by ident, day order by ts, flow) as chain from g),
    k as (select *, row_number() over (partition by ident, day, chain order by ts, flow) as pos from c)
    select s.event_id, s.ident, s.flow from stream s where not exists (select 1 from k where k.pos > 1 and k.ident = s.ident and k.ts = s.ts and k.flow = s.flow)
""")
def repetition_dedup(spark, d):
    return segment.drop_repetitions(stream(spark, d), ["ident"], "ts", ["flow"], 7200).select("event_id", "ident", "flow")


@query(f"""
    with {STREAM}, g as (select *, coalesce(t - lag(t) over (partition by ident order by ts, event_id) > 86400000000, true) as new from stream),
    c as (select *, sum(new::int) over (partition by ident order by ts, event_id) as session from g)
    select ident, session::bigint as session, count(*) as n, min(t) as first_us, max(t) as last_us from c group by ident, session
""")
def sessionise_gap(spark, d):
    s = segment.islands(stream(spark, d), ["ident"], ["ts", "event_id"], F.col("t"), 86_400_000_000, "session")
    return s.groupBy("ident", "session").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_us"), F.max("t").alias("last_us"))


@query(f"with {STREAM} select flow, arg_min(event_id, (t, event_id)) as event_id from stream group by flow, t // 3600000000")
def downsample_first(spark, d):
    return segment.down_sample(stream(spark, d), ["flow"], "ts", 3600, ["event_id"]).select("flow", "event_id")


@query(f"with {STREAM} select ident, flow, k, min(event_id) as event_id from stream group by ident, flow, k")
def dedup_keep_first(spark, d):
    return segment.keep_first(stream(spark, d), ["ident", "flow", "k"], ["event_id"]).select("ident", "flow", "k", "event_id")


@query(f"with {STREAM}, u as (select distinct flow, ident from stream), v as (select *, row_number() over (partition by flow order by ident) as n from u) select event_id from stream join v using (flow, ident) where n <= 20")
def limit_flights_per_flow(spark, d):
    return segment.limit_per_flow(stream(spark, d), ["flow"], "ident", 20).select("event_id")


@query(f"with {STREAM} select event_id, dense_rank() over (order by flow, ident)::bigint as serial from stream")
def renumber_dense(spark, d):
    return segment.renumber(stream(spark, d), ["flow", "ident"], "serial", 1).select("event_id", "serial")


@query(f"with {STREAM}, l as (select *, lag(k // 10) over (partition by ident order by ts, event_id) as before, row_number() over (partition by ident order by ts, event_id) as rn from stream) select event_id from l where rn = 1 or before is distinct from k // 10")
def drop_standing_points(spark, d):
    s = stream(spark, d).withColumn("decade", F.floor(F.col("k") / 10))
    return segment.drop_standing(s, ["ident"], ["ts", "event_id"], ["decade"]).select("event_id")


@query(f"""
    with {STREAM}, e as (select * from stream where flow = 'error'), p as (select * from stream where flow = 'view'),
    j as (select e.event_id, arg_min(p.event_id, p.event_id) as point_id, arg_min(p.ident, p.event_id) as point_ident
          from e join p on abs(e.t - p.t) <= 1800000000 and abs(e.dist - p.dist) <= 25 group by e.event_id)
    select * from j where point_ident is not null
""")
def range_match_first(spark, d):
    s = stream(spark, d)
    e = s.where("flow = 'error'").select("event_id", "ts", F.col("dist").alias("d0"))
    p = s.where("flow = 'view'").select(F.col("event_id").alias("point_id"), F.col("ts").alias("pts"), F.col("dist").alias("d1"), F.col("ident").alias("point_ident"))
    near = F.abs(F.col("d0") - F.col("d1")) <= 25
    return joins.first_match(e, p, "event_id", "ts", "pts", 1800, "point_id", ["point_id", "point_ident"], near, ["point_ident"])


@query(f"""
    with {STREAM}, e as (select event_id, t, case when k % 3 = 0 then null else ident end as i0, case when k % 4 = 0 then null else k // 25 end as k0 from stream where flow = 'purchase')
    select e.event_id, p.event_id as point_id from e join stream p on abs(e.t - p.t) <= 43200000000 and (i0 is null or i0 = p.ident) and (k0 is null or k0 = p.k // 25)
    where i0 is not null or k0 is not null
""")
def slice_join(spark, d):
    s = stream(spark, d)
    e = s.where("flow = 'purchase'").select("event_id", "ts", F.when(F.col("k") % 3 != 0, F.col("ident")).alias("i0"), F.when(F.col("k") % 4 != 0, F.floor(F.col("k") / 25)).alias("k0"))
    p = s.select(F.col("event_id").alias("point_id"), F.col("ts").alias("pts"), F.col("ident").alias("i1"), F.floor(F.col("k") / 25).alias("k1"))
    return joins.slice_join(e, p, "ts", "pts", 43_200, [("i0", "i1"), ("k0", "k1")], ["event_id", "point_id"])


def _sides(spark, d):
    s = stream(spark, d)
    left = s.where("flow = 'purchase'").select("event_id", "ts", "ident")
    right = s.where("flow = 'view'").select(F.col("ts").alias("rts"), "ident", F.col("dist").alias("seen"))
    return left, right


_ASOF = f"""
    with {STREAM}, l as (select event_id, t, ident from stream where flow = 'purchase'), p as (select t, ident, dist from stream where flow = 'view'),
    b as (select l.event_id, p.t as bt, p.dist as bd from l asof left join p on l.ident = p.ident and l.t >= p.t),
"""


@query(_ASOF + """
    f as (select l.event_id, p.t as ft, p.dist as fd from l asof left join p on l.ident = p.ident and l.t <= p.t),
    j as (select l.*, bt, bd, ft, fd, case when bt is null then false when ft is null then true else t - bt <= ft - t end as back from l join b using (event_id) join f using (event_id)),
    m as (select event_id, case when back then bd else fd end as seen, (case when back then bt else ft end - t) / 1e6 as delta from j)
    select event_id, case when abs(delta) <= 172800 then round(seen, 6) end as seen, coalesce(abs(delta) <= 172800, false) as matched, case when abs(delta) <= 172800 then round(delta, 6) end as time_delta_s from m
""")
def asof_nearest_tolerance(spark, d):
    left, right = _sides(spark, d)
    j = joins.asof_nearest(left, right, "event_id", "ts", "rts", ["ident"], ["seen"], 172_800)
    return j.select("event_id", r("seen").alias("seen"), "matched", r("time_delta_s").alias("time_delta_s"))


@query(_ASOF + """
    f as (select l.event_id, p.t as ft, p.dist as fd from l asof left join p on l.ident = p.ident and l.t < p.t),
    j as (select l.*, bt, bd, ft, fd from l join b using (event_id) join f using (event_id)),
    m as (select *, coalesce(t - bt <= 3600000000, false) as nb, coalesce(ft - t <= 3600000000, false) as nf, coalesce(t - bt <= ft - t, true) as first from j)
    select event_id, round(case when nb and (first or not nf) then bd when nf then fd else bd + (fd - bd) * (t - bt) / (ft - bt) end, 6) as seen from m
""")
def asof_interpolated(spark, d):
    left, right = _sides(spark, d)
    return joins.asof_interpolate(left, right, "event_id", "ts", "rts", ["ident"], ["seen"], 3_600).select("event_id", r("seen").alias("seen"))


@query(f"""
    with {STREAM}, p as (select ident // 10 as g, t // 60000000 as m, arg_min(event_id, event_id) as first_id from stream where flow <> 'click' group by 1, 2)
    select s.event_id, p.first_id from stream s left join p on p.g = s.ident // 10 and p.m = s.t // 60000000 where s.flow = 'click'
""")
def first_in_minute(spark, d):
    s = stream(spark, d).withColumn("g", F.floor(F.col("ident") / 10))
    right = s.where("flow <> 'click'").select("g", F.col("ts").alias("rts"), F.col("event_id").alias("first_id"))
    return joins.first_in_minute(s.where("flow = 'click'"), right, "ts", "rts", ["g"], "first_id", ["first_id"]).select("event_id", "first_id")


@query(f"with {STREAM} select event_id from stream where (flow, ident % 3) in (values ('click', 0), ('view', 1), ('error', 2))")
def include_flows(spark, d):
    wanted = spark.createDataFrame([("click", 0), ("view", 1), ("error", 2)], "flow string, g int")
    s = stream(spark, d).withColumn("g", (F.col("ident") % 3).cast("int"))
    return s.join(F.broadcast(wanted), ["flow", "g"], "left_semi").select("event_id")


@query(f"""
    with {STREAM}, f as (select *, first(flow) over (partition by ident order by ts, event_id) as first_flow from stream)
    select event_id from f where first_flow in ('click', 'view') and dist <= 80 qualify count(*) over (partition by ident) >= 2
""")
def first_row_and_distance_filter(spark, d):
    w = Window.partitionBy("ident")
    s = stream(spark, d).withColumn("first_flow", F.first("flow").over(w.orderBy("ts", "event_id")))
    s = s.where(F.trim("first_flow").isin("click", "view")).where("dist <= 80")
    return s.withColumn("n", F.count(F.lit(1)).over(w)).where("n >= 2").select("event_id")


@query(f"with {STREAM}, l as (select ident, abs(dist - lag(dist) over (partition by ident order by ts, event_id)) as leg from stream), n as (select ident from l group by ident having sum(leg) >= 2000) select event_id from stream join n using (ident)")
def min_path_length(spark, d):
    w = Window.partitionBy("ident").orderBy("ts", "event_id")
    s = stream(spark, d).withColumn("leg", F.abs(F.col("dist") - F.lag("dist").over(w)))
    return s.withColumn("length", F.sum("leg").over(Window.partitionBy("ident"))).where("length >= 2000").select("event_id")


@query(f"""
    with {STREAM}, n as (select event_id, case when k % 5 <> 0 then ident end as i from stream), g as (select ident from stream where dist > 99.5 group by ident)
    select event_id from n where i is null or not exists (select 1 from g where g.ident = n.i)
""")
def drop_keys_keep_null(spark, d):
    s = stream(spark, d)
    gone = s.where("dist > 99.5").select("ident").distinct()
    n = s.select("event_id", F.when(F.col("k") % 5 != 0, F.col("ident")).alias("ident"))
    return n.join(gone, "ident", "left_anti").select("event_id")


@query(f"with {STREAM}, a as (select distinct ident from stream where flow = 'error'), b as (select distinct ident from stream where flow = 'signup') select coalesce(a.ident, b.ident) as ident, case when a.ident is null then 'right_only' when b.ident is null then 'left_only' else 'both' end as side from a full join b on a.ident = b.ident")
def compare_flight_sets(spark, d):
    s = stream(spark, d)
    return joins.compare_sets(s.where("flow = 'error'"), s.where("flow = 'signup'"), ["ident"])


@query(f"with {STREAM} select event_id, round(avg(dist) over w, 6) as mean4, round(median(dist) over w, 6) as median4 from stream window w as (partition by ident order by ts, event_id rows between 2 preceding and 1 following)")
def moving_average_median(spark, d):
    s = stream(spark, d).withColumn("m", F.col("dist"))
    s = signal.rolling(s, ["ident"], ["ts", "event_id"], ["dist"], 4, "mean", "_mean")
    s = signal.rolling(s, ["ident"], ["ts", "event_id"], ["m"], 4, "median", "_med")
    return s.select("event_id", r("dist_mean").alias("mean4"), r("m_med").alias("median4"))


@query(f"""
    with recursive {STREAM}, s as (select *, row_number() over (partition by ident order by ts, event_id) as rn from stream),
    a as (select ident, rn, event_id, dist as y from s where rn = 1 union all select s.ident, s.rn, s.event_id, (1 - 2.0::double / 8) * a.y + 2.0::double / 8 * s.dist from a join s on s.ident = a.ident and s.rn = a.rn + 1)
    select ident, (rn - 1)::int as step, round(y, 9) as y from a
""")
def exponential_mean(spark, d):
    t = collect_tracks(stream(spark, d), ["ident"], ["ts", "event_id"], ["dist"])
    return to_steps(t.withColumn("y", ewm_array(F.col("dist"), 7)).select("ident", "y"), ["ident"], ["y"]).select("ident", "step", r("y", 9).alias("y"))


def _savgol_sql(width: int = 5, degree: int = 2) -> str:
    rows, m = signal.savgol_rows(width, degree), width // 2
    term = lambda row, first: " + ".join(f"{row[k]!r}::double * v[{first} + {k}]" for k in range(width))
    cases = " ".join(f"when i = {q + 1} then {term([float(x) for x in rows[q]], '1')} when i = n - {q} then {term([float(x) for x in rows[width - 1 - q]], f'n - {width - 1}')}" for q in range(m))
    inner = term([float(x) for x in rows[m]], f"i - {m}")
    return f"""with {STREAM}, t as (select ident, list(dist order by ts, event_id) as v, list(event_id order by ts, event_id) as e, count(*) as n from stream group by ident),
    u as (select *, unnest(range(1, n + 1)) as i from t)
    select e[i] as event_id, round(case when n < {width} then v[i] {cases} else {inner} end, 6) as smooth from u"""


@query(_savgol_sql())
def savitzky_golay(spark, d):
    s = signal.savgol(stream(spark, d), ["ident"], ["ts", "event_id"], ["dist"], 5, 2, "_s")
    return s.select("event_id", r("dist_s").alias("smooth"))


@query(f"""
    with {STREAM}, w as (select event_id, dist, count(*) over w as n, avg(dist) over w as m, stddev_samp(dist) over w as s from stream window w as (partition by flow order by ts, event_id rows between 2 preceding and 2 following))
    select event_id, case when n = 5 then abs(dist - m) <= 1.5 * s else true end as inlier from w
""")
def rolling_outliers(spark, d):
    return signal.rolling_outliers(stream(spark, d), ["flow"], ["ts", "event_id"], "dist", 5, 1.5).select("event_id", "inlier")


@query(f"""
    with {STREAM}, l as (select *, case when t - lag(t) over w > 0 then sqrt(power(dist - lag(dist) over w, 2) + power(k - lag(k) over w, 2)) / ((t - lag(t) over w) / 1e6) end as leg from stream window w as (partition by ident order by ts, event_id)),
    b as (select *, lead(leg) over (partition by ident order by ts, event_id) as nxt from l)
    select event_id, round(case when leg is null then nxt when nxt is null then leg else (leg + nxt) / 2 end, 8) as speed from b
""")
def point_speeds(spark, d):
    s = signal.speeds(stream(spark, d), ["ident"], ["ts", "event_id"], "dist", "k", "t", 1e6)
    return s.select("event_id", r("speed", 8).alias("speed"))


@query(f"""
    with {STREAM}, d as (select (t - lag(t) over (partition by ident order by ts, event_id)) / 1e6 as d from stream)
    select count(d) as n, round(avg(d), 6) as mean, round(quantile_cont(d, 0.5), 6) as p50, round(quantile_cont(d, 0.9), 6) as p90, round(quantile_cont(d, 0.99), 6) as p99, round(max(d), 6) as max,
           round(100.0 * count(*) filter (d > 5) / count(d), 6) as over_5s, round(100.0 * count(*) filter (d > 30) / count(d), 6) as over_30s, round(100.0 * count(*) filter (d > 120) / count(d), 6) as over_120s from d where d >= 0
""")
def sampling_deltas(spark, d):
    x = stats.deltas(stream(spark, d), ["ident"], "ts", tie=["event_id"])
    return x.select("n", *[r(c).alias(c) for c in x.columns if c != "n"])


_EVEN = """
    p as (select ident, k, v, t, n, (n - 1) * k / 15.0::double as p from g, unnest(range(0, 16)) as u(k))
"""


@query(f"""
    with {STREAM}, g as (select ident, list(dist order by ts, event_id) as v, list(t / 1e6 order by ts, event_id) as t, count(*) as n from stream group by ident), {_EVEN},
    q as (select *, least(floor(p)::bigint, n - 1) as i from p)
    select ident, k::int as step, round(v[i + 1] + (v[least(i + 1, n - 1) + 1] - v[i + 1]) * (p - i), 6) as dist from q
""")
def resample_index(spark, d):
    t = collect_tracks(stream(spark, d), ["ident"], ["ts", "event_id"], ["dist"])
    return to_steps(resample(t, ["dist"], 16).select("ident", "dist"), ["ident"], ["dist"]).select("ident", "step", r("dist").alias("dist"))


_DOMAIN = """
    x as (select ident, k, s, v, n, case when k = 15 then s[n] else s[1] + (s[n] - s[1]) * k / 15.0::double end as here from g, unnest(range(0, 16)) as u(k)),
    i as (select *, greatest(len(list_filter(s, lambda q: q <= here)), 1) as i from x),
    j as (select *, least(i + 1, n) as j from i)
    select ident, k::int as step, round(here, 6) as here, round(v[i] + case when s[j] > s[i] then (v[j] - v[i]) * (here - s[i]) / (s[j] - s[i]) else 0 end, 6) as dist from j
"""


@query(f"with {STREAM}, h as (select *, (t - min(t) over (partition by ident)) / 1e6 as sec from stream), g as (select ident, list(dist order by ts, event_id) as v, list(sec order by ts, event_id) as s, count(*) as n from h group by ident), {_DOMAIN}")
def resample_time(spark, d):
    s = stream(spark, d).withColumn("here", (F.col("t") - F.min("t").over(Window.partitionBy("ident"))) / 1e6)
    t = resample(collect_tracks(s, ["ident"], ["ts", "event_id"], ["here", "dist"]), ["dist"], 16, "here")
    return to_steps(t.select("ident", "here", "dist"), ["ident"], ["here", "dist"]).select("ident", "step", r("here").alias("here"), r("dist").alias("dist"))


@query(f"""
    with {STREAM}, l as (select *, coalesce(sqrt(power(dist - lag(dist) over w, 2) + power(k - lag(k) over w, 2)), 0) as seg from stream window w as (partition by ident order by ts, event_id)),
    h as (select *, sum(seg) over (partition by ident order by ts, event_id) as s from l),
    g as (select ident, list(dist order by ts, event_id) as v, list(s order by ts, event_id) as s, count(*) as n from h group by ident), {_DOMAIN}
""")
def resample_arc_length(spark, d):
    s = signal.chainage(stream(spark, d), ["ident"], ["ts", "event_id"], "dist", "k", "here")
    t = resample(collect_tracks(s, ["ident"], ["ts", "event_id"], ["here", "dist"]), ["dist"], 16, "here")
    return to_steps(t.select("ident", "here", "dist"), ["ident"], ["here", "dist"]).select("ident", "step", r("here").alias("here"), r("dist").alias("dist"))


@query()
def resample_pchip(spark, d):
    from ..operators.resample import pchip_tracks

    s = stream(spark, d).withColumn("here", (F.col("t") - F.min("t").over(Window.partitionBy("ident"))) / 1e6)
    t = pchip_tracks(collect_tracks(s, ["ident"], ["ts", "event_id"], ["here", "dist"]), ["dist"], "here", 20)
    return to_steps(t.select("ident", "here", "dist"), ["ident"], ["here", "dist"]).select("ident", "step", r("here").alias("here"), r("dist").alias("dist"))


@query()
def preprocess_flights(spark, d):
    """The whole preprocessing plan: segments, filters, smoothing, resampling by time."""
    from .preprocess import Settings, preprocess

    s = stream(spark, d).withColumn("y", F.col("k").cast("double"))
    p = preprocess(s, ["flow"], [], "ts", "event_id", ("dist", "y"), "dist", s=Settings(gap_s=3_600, jump_m=60, min_points=3, n_points=8, width=3, degree=1))
    return p.select("flight_id", "flow", "step", r("t").alias("t"), r("dist").alias("dist"), r("y").alias("y"))


@query(f"with {STREAM}, g as (select ident, flow, count(*) as n_points, arg_min(dist, (t, event_id)) as first_dist, arg_max(dist, (t, event_id)) as last_dist, arg_min(k, (t, event_id)) as first_k, arg_max(k, (t, event_id)) as last_k from stream group by ident, flow) select ident, flow, round(first_dist, 6) as first_dist, round(last_dist, 6) as last_dist, first_k, last_k from g")
def flight_endpoints(spark, d):
    e = stats.endpoints(stream(spark, d), ["ident", "flow"], ["t", "event_id"], ["dist", "k"])
    return e.select("ident", "flow", r("first_dist").alias("first_dist"), r("last_dist").alias("last_dist"), "first_k", "last_k")


@query("with s as (select session_id, count(*) as n from (select user_id, ts, sum(new::int) over (partition by user_id order by ts) as session_id from (select user_id, ts, coalesce(epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) >= 21600000000, true) as new from events)) group by user_id, session_id) select n, count(*) as n_sessions from s group by n")
def session_windows(spark, d):
    from ..streaming.windows import sessions

    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return sessions(e, ["user_id"], "ts", "6 hours", "1 hour", [F.count(F.lit(1)).alias("n")]).groupBy("n").agg(F.count(F.lit(1)).alias("n_sessions"))
