"""Instants, local times and bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats that time fields come in.
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]X", "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy HH:mm", "yyyyMMddHHmm")


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    name = ts if isinstance(ts, str) else ts
    c = F.col(name) if isinstance(name, str) else name
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def seconds(ts: str | Column) -> Column:
    return micros(ts) / 1_000_000


def parse(c: Column, *formats: str) -> Column:
    """The first format that fits, or null."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats or FORMATS])


def _last_sunday(year: Column, month: int) -> Column:
    end = F.make_date(year, F.lit(month), F.lit(31))
    return F.date_sub(end, F.dayofweek(end) - 1)


def berlin_to_utc(local: Column) -> Column:
    """Wall-clock time of Berlin as UTC, both without zone.

    Summer time lasts from 02:00 of March's last Sunday to 03:00 of October's. Times in the gap move
    to its end; times in the overlap are taken as standard time.
    """
    c = local.cast("timestamp_ntz")
    year = F.year(c)
    begin = F.date_add(_last_sunday(year, 3), 0).cast("timestamp_ntz") + F.expr("INTERVAL 2 HOURS")
    resume = begin + F.expr("INTERVAL 1 HOUR")
    end = _last_sunday(year, 10).cast("timestamp_ntz") + F.expr("INTERVAL 2 HOURS")
    moved = F.when((c >= begin) & (c < resume), resume).otherwise(c)
    return F.when((moved >= resume) & (moved < end), moved - F.expr("INTERVAL 2 HOURS")).otherwise(moved - F.expr("INTERVAL 1 HOUR"))


def season_offset_hours(c: Column) -> Column:
    """The older fixed rule: 2 hours from March 28 to October 30, else 1."""
    md = F.month(c) * 100 + F.dayofmonth(c)
    return F.when((md >= 328) & (md <= 1030), 2).otherwise(1)


def time_bin(ts: str | Column, width: float) -> Column:
    """Number of the ``width``-second bin since 1970."""
    return F.floor(micros(ts) / F.lit(int(width * 1_000_000))).cast("long")


def float_seconds(c: Column) -> Column:
    """A time-like text as seconds: a number as it is, else a timestamp."""
    return F.coalesce(c.try_cast("double"), seconds(F.try_to_timestamp(c).cast("timestamp_ntz")))
