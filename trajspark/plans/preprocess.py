"""From matched points to resampled flights, as one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import resample, segment, signal


@dataclass
class Settings:
    """What a variant may change; ``n_points`` of None leaves the flights as they are."""

    gap_s: float = 300.0
    jump_m: float = 1_000.0
    min_points: int = 2
    max_distance: float | None = None
    min_length: float = 0.0
    runways: Sequence[str] | None = None
    smooth: str | None = "savgol"
    width: int = 7
    degree: int = 2
    simplify: float | None = None
    n_points: int | None = 40
    domain: str | None = "t"


def preprocess(points: DataFrame, flow: Sequence[str], identity: Sequence[str], ts: str, tie: str, xy: tuple[str, str], distance: str, others: Sequence[str] = (), runway: str | None = None, s: Settings | None = None, meta: Sequence[str] = ()) -> DataFrame:
    """Segment, filter, simplify, smooth and resample; returns flight_id, the flow, step, the columns and each flight's first
    known row's ``meta`` (identifiers, types, serial numbers)."""
    s = s or Settings()
    x, y = xy
    cols = list(dict.fromkeys([x, y, distance, *others]))
    p = segment.segment_flights(points, flow, [ts, tie], ts, distance, identity, s.gap_s, s.jump_m, s.min_points)
    order = [ts, tie]
    one = Window.partitionBy("flight_id")
    if runway and s.runways:
        first = F.first(runway).over(one.orderBy(*order))
        p = p.withColumn("_r", F.trim(first)).where(F.col("_r").isin(*s.runways)).drop("_r")
    if s.max_distance is not None:
        p = p.where(F.col(distance) <= s.max_distance)
    p = p.withColumn("_n", F.count(F.lit(1)).over(one)).where("_n >= 2").drop("_n")
    if s.min_length > 0:
        p = signal.chainage(p, ["flight_id"], order, x, y, "_s").withColumn("_l", F.max("_s").over(one)).where(F.col("_l") >= s.min_length).drop("seg", "_s", "_l")
    first_rows = p.groupBy("flight_id").agg(F.min_by(F.struct(*meta), F.struct(*order)).alias("_meta")).select("flight_id", "_meta.*") if meta else None
    whole = lambda d: d.join(first_rows, "flight_id") if meta else d
    p = p.withColumn("t", F.unix_micros(F.col(ts).cast("timestamp")) / 1e6)
    p = p.withColumn("t", F.col("t") - F.min("t").over(one))
    if s.simplify:
        tracks = resample.collect_tracks(p, ["flight_id", *flow], order, [*cols, "t"])
        p = resample.to_steps(resample.simplify_tracks(tracks, x, y, s.simplify, [c for c in [*cols, "t"] if c not in (x, y)]).drop("n"), ["flight_id", *flow], [*cols, "t"])
        order = ["step"]
    smooth = [c for c in cols if c != distance]
    if s.smooth == "savgol":
        p = signal.savgol(p, ["flight_id"], order, smooth, s.width, s.degree)
    elif s.smooth:
        p = signal.rolling(p, ["flight_id"], order, smooth, s.width, s.smooth)
    if s.n_points is None:
        return whole(p.withColumn("step", F.row_number().over(one.orderBy(*order)) - 1).drop(*meta))
    tracks = resample.collect_tracks(p, ["flight_id", *flow], order, [*cols, "t"])
    done = resample.resample(tracks, cols, s.n_points, s.domain)
    return whole(resample.to_steps(done.drop("n", *(["t"] if s.domain is None else [])), ["flight_id", *flow], [*cols, *(["t"] if s.domain else [])]))


def legacy(points: DataFrame, keys: Sequence[str], ts: str, tie: str, cols: Sequence[str], n: int = 20, width: int = 5, spread: float = 3.0) -> DataFrame:
    """The older preparation, one row a track: ``raw_points`` and ``processed_points``, of which outliers are taken out of every
    column, the rest smoothed by a rolling mean, and ``n`` points interpolated by pchip along time. Tracks of fewer than three points have none."""
    order = [ts, tie]
    raw = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *cols))).alias("raw_points"))
    p = points.withColumn("t", F.unix_micros(F.col(ts).cast("timestamp")) / 1e6)
    for c in cols:
        p = signal.rolling_outliers(p, keys, order, c, width, spread).where(F.coalesce("inlier", F.lit(True))).drop("inlier")
    p = signal.rolling(p, keys, order, cols, width)
    done = resample.pchip_tracks(resample.collect_tracks(p, keys, order, ["t", *cols]), cols, "t", n)
    zipped = F.arrays_zip(*[F.col(c) for c in ["t", *cols]]).alias("processed_points")
    return raw.join(done.select(*keys, zipped), list(keys), "left")
