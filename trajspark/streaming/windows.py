"""Event-time windows over unbounded points; each works on a static table as well, where watermarks do nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sessions(points: DataFrame, keys: Sequence[str], ts: str, gap: str, late: str, aggregates: Sequence[Column]) -> DataFrame:
    """Sessions that end after ``gap`` without a point, closed ``late`` after their end."""
    g = points.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(*aggregates)
    return g.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in g.columns if c not in (*keys, "w")])


def first_samples(points: DataFrame, keys: Sequence[str], ts: str, width: str, late: str, take: Sequence[str]) -> DataFrame:
    """The earliest point of each tumbling window."""
    g = points.withWatermark(ts, late).groupBy(*keys, F.window(ts, width).alias("w")).agg(F.min_by(F.struct(ts, *take), ts).alias("p"))
    return g.select(*keys, "p.*")


def band_join(events: DataFrame, points: DataFrame, event_ts: str, point_ts: str, tolerance: str, late: str, on: Column | None = None) -> DataFrame:
    """Pairs within the tolerance; state is dropped once the watermarks have passed."""
    e, p = events.withWatermark(event_ts, late), points.withWatermark(point_ts, late)
    near = F.col(point_ts).between(F.col(event_ts) - F.expr(f"INTERVAL {tolerance}"), F.col(event_ts) + F.expr(f"INTERVAL {tolerance}"))
    return e.join(p, near if on is None else on & near)
