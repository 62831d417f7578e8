"""Filters and look-ups of whole flights."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.idents import normalise
from .joins import band_join
from .stats import endpoints, robust_outliers

MODES = ("start", "anchor", "both", "either")


def endpoint_outliers(points: DataFrame, flow: Sequence[str], flight: str, order: Sequence[str], xy: tuple[str, str], k: float = 3.0) -> DataFrame:
    """(flow, flight, start_out, anchor_out): whether a flight's first and last point are far from those of its flow."""
    ends = endpoints(points, [*flow, flight], order, list(xy))
    x, y = xy
    first = robust_outliers(ends, flow, [f"first_{x}", f"first_{y}"], k).select(*flow, flight, F.col("outlier").alias("start_out"))
    last = robust_outliers(ends, flow, [f"last_{x}", f"last_{y}"], k).select(*flow, flight, F.col("outlier").alias("anchor_out"))
    return first.join(last, [*flow, flight])


def drop_endpoint_outliers(points: DataFrame, flow: Sequence[str], flight: str, order: Sequence[str], xy: tuple[str, str], mode: str = "either", k: float = 3.0) -> DataFrame:
    """Points of all flights but the outliers by ``mode``: at the start, at the anchor, at both ends, or at either."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")
    out = endpoint_outliers(points, flow, flight, order, xy, k)
    a, b = F.col("start_out"), F.col("anchor_out")
    bad = out.where({"start": a, "anchor": b, "both": a & b, "either": a | b}[mode]).select(*flow, flight)
    return points.join(bad, [*flow, flight], "left_anti")


def match_filter(points: DataFrame, flight: str, order: Sequence[str], matched: Column, want: str = "all") -> DataFrame:
    """Points of flights whose first row is matched, unmatched, or of all; a null counts as unmatched."""
    if want not in ("all", "matched", "unmatched"):
        raise ValueError(f"{want!r} is none of all, matched, unmatched")
    if want == "all":
        return points
    first = points.groupBy(flight).agg(F.min_by(F.coalesce(matched, F.lit(False)), F.struct(*order)).alias("_m"))
    keep = first.where(F.col("_m") if want == "matched" else ~F.col("_m")).select(flight)
    return points.join(keep, flight, "left_semi")


def drop_empty(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows without any value go; with ``subset``, those that lack one of its columns."""
    return df.dropna("any", subset=list(subset)) if subset else df.dropna("all")


def direction(points: DataFrame, flight: Sequence[str], ts: str, altitude: str, tie: Sequence[str] = ()) -> DataFrame:
    """(flight, direction, runway_time): A if the last known altitude is below the first, else D (also without altitudes).

    The runway's time is an arrival's last point and a departure's first.
    """
    at = F.when(F.col(altitude).isNotNull(), F.struct(ts, *tie))
    g = points.groupBy(*flight).agg(F.min_by(altitude, at).alias("_first"), F.max_by(altitude, at).alias("_last"), F.min(ts).alias("_from"), F.max(ts).alias("_to"))
    arrives = F.coalesce(F.col("_last") < F.col("_first"), F.lit(False))
    return g.select(*flight, F.when(arrives, "A").otherwise("D").alias("direction"), F.when(arrives, F.col("_to")).otherwise(F.col("_from")).alias("runway_time"))


def by_identity(points: DataFrame, identity: Sequence[str], wanted: DataFrame, flight: str) -> DataFrame:
    """Points of the flight of smallest number that has each wanted identity."""
    first = points.join(wanted.select(*identity).distinct(), list(identity)).groupBy(*identity).agg(F.min(flight).alias(flight))
    return points.join(first, [*identity, flight], "left_semi")


def with_types(df: DataFrame, types: DataFrame, ident: str = "icao24", type_: str = "typecode") -> DataFrame:
    """Left join of the table of types, one row for each identifier (its first type by name), by normalised identifiers."""
    t = types.select(normalise(F.col(ident)).alias("_ident"), F.col(type_)).where("_ident is not null").groupBy("_ident").agg(F.min(type_).alias(type_))
    return df.join(t, normalise(F.col(ident)) == F.col("_ident"), "left").drop("_ident")


def near_flights(events: DataFrame, points: DataFrame, types: DataFrame, event_id: str, event_ts: str, point_ts: str, tolerance_s: float, box: Column, wants: tuple[str, str], moves: str, ident: str = "icao24") -> DataFrame:
    """All flights that an event may belong to: (event, ident, type, direction).

    Points within ``tolerance_s`` and ``box`` name the candidates; a candidate stays if its type is unknown or the
    event's (``wants``: event's column, type's column) and it moves as the event says (column ``moves``, A or D).
    """
    want, kind = wants
    hits = band_join(events, points, event_ts, point_ts, tolerance_s, residual=box).select(event_id, want, moves, ident).distinct()
    typed = with_types(hits, types, ident, kind)
    fits = typed.where(F.col(kind).isNull() | F.col(want).isNull() | (F.col(kind) == F.col(want)))
    moving = points.join(fits.select(ident).distinct(), ident, "left_semi")
    return fits.join(direction(moving, [ident], point_ts, "altitude"), ident).where(F.col(moves).isNull() | (F.col(moves) == F.col("direction"))).select(event_id, ident, kind, "direction")


def alignment_errors(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """A rebuilt table against the stored one: rows in both or one, and mean and greatest distance of ``cols``."""
    l = a.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in cols], F.lit(1).alias("_in_a"))
    r = b.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in cols], F.lit(1).alias("_in_b"))
    gap = F.sqrt(reduce(lambda x, y: x + y, [(F.col(f"_a_{c}") - F.col(f"_b_{c}")) ** 2 for c in cols]))
    both = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    return l.join(r, list(keys), "full").agg(
        F.count_if(both).alias("aligned"), F.count_if(F.col("_in_b").isNull()).alias("left_only"), F.count_if(F.col("_in_a").isNull()).alias("right_only"),
        F.avg(gap).alias("mean_gap"), F.max(gap).alias("max_gap"),
    )
