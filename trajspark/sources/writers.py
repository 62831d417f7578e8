"""Writing tables, nested columns, map files and reports."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def parquet_and_csv(df: DataFrame, parquet: str, csv: str | None = None, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(parquet)
    if csv:
        flat(df).write.mode("overwrite").option("header", True).csv(csv)


def append(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Add rows to a table that may exist, as Parquet or CSV."""
    w = (flat(df) if kind == "csv" else df).write.mode("append")
    w.option("header", True).csv(path) if kind == "csv" else w.parquet(path)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = (ArrayType, MapType, StructType)
    return df.select(*[F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields])


def ground_tracks(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("sep", ";").csv(path)


def cache_path(root: str, **what) -> str:
    """A folder named by the hash of what it holds: the same question finds the same answer."""
    return f"{root}/dist_{hashlib.sha1(json.dumps(what, sort_keys=True, default=str).encode()).hexdigest()}"


def transposed(df: DataFrame, name: str, attributes: Sequence[str]) -> DataFrame:
    """One row an attribute, in order, one column a track. The number of tracks is that of a single export."""
    each = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for i, a in enumerate(attributes)])
    return df.select(name, F.inline(each)).groupBy("_i", "attribute").pivot(name).agg(F.first("value")).orderBy("_i").drop("_i")


def placemark(name: Column, lon: Column, lat: Column, alt: Column, style: Column) -> Column:
    """A KML LineString of arrays of coordinates."""
    safe = F.replace(F.replace(F.replace(name, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    points = F.array_join(F.transform(F.arrays_zip(lon.alias("lon"), lat.alias("lat"), alt.alias("alt")), lambda p: F.concat_ws(",", p["lon"].cast("string"), p["lat"].cast("string"), p["alt"].cast("string"))), " ")
    return F.concat(F.lit("<Placemark><name>"), safe, F.lit("</name><styleUrl>#"), style, F.lit("</styleUrl><LineString><coordinates>"), points, F.lit("</coordinates></LineString></Placemark>"))


def kml(placemarks: Sequence[str], colours: dict[str, str]) -> str:
    """A document of (few, sampled) placemarks with a style for each flow."""
    styles = "".join(f'<Style id="{k}"><LineStyle><color>{v}</color><width>2</width></LineStyle></Style>' for k, v in sorted(colours.items()))
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document>{styles}{"".join(placemarks)}</Document></kml>\n'


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table; more than ``most`` rows are an error, not a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)]) + "\n"
