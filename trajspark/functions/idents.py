"""Identifiers, flags and other text fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing identifier.
NULL_TOKENS = ("", "NA", "NAN", "NONE", "<NA>")
TRUE_TOKENS = ("TRUE", "T", "YES", "Y", "1", "1.0")
FALSE_TOKENS = ("FALSE", "F", "NO", "N", "0", "0.0")


def normalise(c: Column) -> Column:
    """Trimmed upper case, or null for what only says that nothing is known."""
    u = F.upper(F.trim(c.cast("string")))
    return F.when(~u.isin(*NULL_TOKENS), u)


def microphone(c: Column) -> Column:
    """'MP 3', 'mp3' and 'M3' are M03."""
    u = F.regexp_replace(F.upper(c), " ", "")
    return F.regexp_replace(F.regexp_replace(u, "^MP", "M"), "^M(\\d)$", "M0$1")


def decimal_comma(c: Column) -> Column:
    """'12,5' as 12.5; null where it is no number."""
    return F.regexp_replace(F.trim(c), ",", ".").try_cast("double")


def parse_bool(c: Column) -> Column:
    u = F.upper(F.trim(c.cast("string")))
    return F.when(u.isin(*TRUE_TOKENS), True).when(u.isin(*FALSE_TOKENS), False)


def first_known(*cs: Column, default: str = "UNKNOWN") -> Column:
    """The first of several fields that holds something."""
    return F.coalesce(*[normalise(c) for c in cs], F.lit(default))


def same_type(a: Column, b: Column) -> Column:
    """Whether two type codes agree; null unless both are known."""
    return normalise(a) == normalise(b)


def flow_label(*cs: Column) -> Column:
    return F.concat_ws("_", *[F.coalesce(c.cast("string"), F.lit("NA")) for c in cs])


def safe_name(c: Column) -> Column:
    """A file name: runs of anything but letters, digits, dot, dash become one underscore."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), "[^A-Za-z0-9.-]+", "_"), "^_+|_+$", "")


def year_month(file_name: Column) -> Column:
    """'..._2022-04.parquet' as 2022-04: first four-digit year and two-digit month of a name."""
    y, m = F.regexp_extract(file_name, "(20\\d{2})[-_]?(0[1-9]|1[0-2])", 1), F.regexp_extract(file_name, "(20\\d{2})[-_]?(0[1-9]|1[0-2])", 2)
    return F.when(y != "", F.concat_ws("-", y, m))


def trailing_id(file_name: Column) -> Column:
    """The number at the end of a name, before its extension."""
    return F.regexp_extract(file_name, "(\\d+)(?:\\.[A-Za-z]+)*$", 1).try_cast("int")
