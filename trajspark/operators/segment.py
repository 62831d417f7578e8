"""Ordered operators: flights out of point streams, repeated events, sessions, first samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions.timeops import micros
from . import ranks
from .ranks import SLICE


def segment_flights(
    points: DataFrame,
    flow: Sequence[str],
    order: Sequence[str],
    ts: str,
    distance: str | None = None,
    identity: Sequence[str] = (),
    gap_s: float = 300.0,
    jump_m: float = 1_000.0,
    min_points: int = 1,
    dense: bool = True,
    slices: int | None = None,
) -> DataFrame:
    """Split each flow's points, in ``order``, into flights; adds ``flight_seq`` within the flow and, if ``dense``, ``flight_id``.

    A point begins a flight if an identity that is known on both sides changes, the time gap exceeds
    ``gap_s``, the distance jumps by more than ``jump_m``, or the sign of the distance's change flips.
    After a boundary the direction is forgotten, so a flip cannot follow one at once. In a run of
    flips every other one therefore counts; which, depends on how the run began: at the last point
    that is no flip or has another reason (the anchor). So boundaries need the two points before, and
    one running "last anchor", not a sequential scan.

    A flow may hold any share of the points: it is walked in slices of time, and each slice is given the
    last two points, the anchor and the counts of those before it, one small row a slice. Runs jobs.
    Points without a flow are dropped; null distances neither jump nor flip.
    """
    p = points.where(" and ".join(f"`{c}` is not null" for c in flow)).withColumn("_t", micros(ts))
    carried = ["_t", *identity, *([distance] if distance else [])]
    fields = F.struct(*[F.col(c).alias(f"f{i}") for i, c in enumerate(carried)])
    by = [*flow, SLICE]
    inside = Window.partitionBy(*by).orderBy(*order)
    walk = Window.partitionBy(*flow).orderBy(SLICE)

    d = ranks.sliced(p, flow, order, slices)
    # The last two points of the slices before: each slice has one at least, so that two slices hold them.
    tail = d.withColumn("_back", F.row_number().over(Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order]))).where("_back <= 2")
    tails = tail.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct((-F.col("_back")).alias("b"), fields.alias("f")))).alias("_tail"))
    earlier = F.flatten(F.collect_list("_tail").over(walk.rowsBetween(-2, -1)))
    tails = tails.select(*by, F.transform(earlier, lambda x: x["f"]).alias("_earlier"))
    d = ranks.beside(d.withColumns({"_i": F.row_number().over(inside), "_one": F.lag(fields, 1).over(inside), "_two": F.lag(fields, 2).over(inside)}), tails, by)
    last = lambda k: F.get("_earlier", F.size("_earlier") - k)
    d = d.withColumns({"_one": F.coalesce("_one", last(1)), "_two": F.when(F.col("_i") == 1, last(2)).when(F.col("_i") == 2, last(1)).otherwise(F.col("_two"))})

    one = {c: F.col(f"_one.f{i}") for i, c in enumerate(carried)}
    two = {c: F.col(f"_two.f{i}") for i, c in enumerate(carried)}
    hard = (F.col("_t") - one["_t"]) > int(gap_s * 1_000_000)
    for c in identity:
        hard = hard | F.coalesce(F.col(c) != one[c], F.lit(False))
    hard = F.coalesce(hard, F.lit(False))
    flip = F.lit(False)
    if distance:
        step, past = F.col(distance) - one[distance], one[distance] - two[distance]
        hard = hard | F.coalesce(F.abs(step) > jump_m, F.lit(False))
        flip = F.coalesce((step != 0) & (past != 0) & (F.signum(step) != F.signum(past)), F.lit(False))
    begins = F.col("_one").isNull() | hard
    d = cut(d.withColumns({"_begins": begins, "_flip": flip}).drop("_one", "_two", "_earlier"))

    # Places within the flow, and the last anchor of the slices before.
    d = ranks.beside(d, ranks.before(d, flow, {"_before": F.count(F.lit(1))}), by)
    d = d.withColumn("_rn", F.col("_i") + F.col("_before")).drop("_before")
    own = F.when(F.col("_begins") | ~F.col("_flip"), F.struct("_rn", "_begins"))
    ends = d.groupBy(*by).agg(F.max(own).alias("_last"))
    ends = ends.select(*by, F.last("_last", ignorenulls=True).over(walk.rowsBetween(Window.unboundedPreceding, -1)).alias("_past"))
    d = ranks.beside(d.withColumn("_anchor", F.last(own, ignorenulls=True).over(inside)), ends, by)
    d = d.withColumn("_anchor", F.coalesce("_anchor", "_past"))
    odd = (F.col("_rn") - F.col("_anchor._rn")) % 2 == 1
    d = d.withColumn("_start", (F.col("_anchor._begins") != odd).cast("long")).drop("_past", "_anchor", "_begins", "_flip", "_rn", "_i", "_t")
    d = ranks.beside(d, ranks.before(d, flow, {"_before": F.sum("_start")}), by)
    d = d.withColumn("flight_seq", F.sum("_start").over(inside) + F.col("_before")).drop("_start", "_before", SLICE)
    if min_points > 1:
        n = d.groupBy(*flow, "flight_seq").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_points).drop("_n")
        d = d.join(n, [*flow, "flight_seq"], "left_semi")
    return renumber(d, [*flow, "flight_seq"], "flight_id") if dense else d


def renumber(df: DataFrame, keys: Sequence[str], name: str, start: int = 0) -> DataFrame:
    """Dense numbers of the sorted distinct keys, joined back."""
    ids = ranks.ranked_rows(df.select(*keys).distinct(), [], list(keys), name)
    return df.join(ids.withColumn(name, F.col(name) - 1 + start), list(keys))


def limit_per_flow(df: DataFrame, flow: Sequence[str], flight: str, n: int) -> DataFrame:
    """Rows of the first ``n`` flights of each flow."""
    w = Window.partitionBy(*flow).orderBy(flight)
    return df.withColumn("_k", F.dense_rank().over(w)).where(F.col("_k") <= n).drop("_k")


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], t: Column, gap: float, name: str = "island") -> DataFrame:
    """Number runs of rows whose neighbours are at most ``gap`` apart (chained, not anchored)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("_t", t).withColumn("_new", F.coalesce((F.col("_t") - F.lag("_t").over(w)) > gap, F.lit(True)).cast("long"))
    return d.withColumn(name, F.sum("_new").over(w)).drop("_t", "_new")


def repeated_events(events: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], window_s: float, same_day: bool = True) -> DataFrame:
    """Distinct events of each identity with ``chain`` and ``keep``: of a chain within ``window_s``, the first stays."""
    e = events.select(*keys, ts, *[c for c in tie if c not in keys]).where(" and ".join(f"`{k}` is not null" for k in keys)).distinct()
    by = list(keys)
    if same_day:
        e, by = e.withColumn("_day", F.to_date(ts)), [*keys, "_day"]
    e = islands(e, by, [ts, *tie], micros(ts), window_s * 1_000_000, "chain")
    e = e.withColumn("keep", F.row_number().over(Window.partitionBy(*by, "chain").orderBy(ts, *tie)) == 1)
    return e.drop("_day")


def drop_repetitions(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], window_s: float, same_day: bool = True) -> DataFrame:
    """Rows of all but the first event of every chain go; rows with a null key stay."""
    on = list(dict.fromkeys([*keys, ts, *tie]))
    gone = repeated_events(df, keys, ts, tie, window_s, same_day).where(~F.col("keep")).select(*on)
    return df.join(gone, on, "left_anti")


def keep_first(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def down_sample(df: DataFrame, keys: Sequence[str], ts: str, width_s: float, order: Sequence[str]) -> DataFrame:
    """The first sample of each ``width_s`` bin."""
    from ..functions.timeops import time_bin

    return keep_first(df.withColumn("_bin", time_bin(ts, width_s)), [*keys, "_bin"], [ts, *order]).drop("_bin")


def drop_standing(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Points equal to the one before them go."""
    w = Window.partitionBy(*keys).orderBy(*order)
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.lag(v).over(w))
    return df.withColumn("_same", same & (F.row_number().over(w) > 1)).where(~F.col("_same")).drop("_same")


def sample_ranked(df: DataFrame, keys: Sequence[str], unit: str, n: int, seed: int = 0) -> DataFrame:
    """Rows of ``n`` units of each key, chosen by the hash of (seed, unit): the same whatever the partitions."""
    units = df.select(*keys, unit).distinct()
    w = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), F.col(unit)), unit)
    return df.join(units.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k"), [*keys, unit], "left_semi")
