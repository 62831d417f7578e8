"""Reading points, events, weather, maps and tracks."""

from __future__ import annotations

import io
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeops import FORMATS, parse


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The table itself, or an error that names the missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def resolve(df: DataFrame, synonyms: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rename columns to their canonical names; letters and digits count, case and punctuation don't."""
    plain = lambda s: "".join(ch for ch in s.lower() if ch.isalnum())
    have = {plain(c): c for c in reversed(df.columns)}
    for name, others in synonyms.items():
        found = next((have[plain(o)] for o in (name, *others) if plain(o) in have), None)
        if found and found != name and name not in df.columns:
            df = df.withColumnRenamed(found, name)
    return df


def contract(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """The contract's columns first, cast, nulls where missing; then the rest."""
    first = [(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()]
    return df.select(*first, *[f"`{c}`" for c in df.columns if c not in columns])


def csv(spark: SparkSession, paths: Sequence[str] | str, sep: str = ",", schema: str | None = None, parse_dates: Sequence[str] = (), first: int | None = None) -> DataFrame:
    """CSV files of drifting columns: each is read by its own header, and they are united by name, in order of their paths.

    ``_file`` and ``_row`` tell rows apart. Those of ``parse_dates`` that a file has become timestamps. ``first`` keeps
    that many rows in order of files and rows. A pattern without a file is an error.
    """
    r = spark.read.option("header", True).option("sep", sep)
    each = sorted(matching(spark, [paths] if isinstance(paths, str) else list(paths)))
    if not each:
        raise FileNotFoundError(f"no file matches {paths}")
    frames = []
    for i, p in enumerate(each):
        d = (r.schema(schema) if schema else r.option("inferSchema", True)).csv(p)
        dates = {c: parse(F.col(f"`{c}`").cast("string"), *FORMATS).cast("timestamp_ntz") for c in parse_dates if c in d.columns}
        frames.append(d.withColumns({**dates, "_file": F.lit(p.rsplit("/", 1)[-1]), "_order": F.lit(i), "_row": F.monotonically_increasing_id()}))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if first is not None:
        out = out.orderBy("_order", "_row").limit(first)
    return out.drop("_order")


def matching(spark: SparkSession, patterns: Sequence[str]) -> list[str]:
    """Paths of files that match, in any store that Spark reads."""
    out = []
    for p in patterns:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        out += [f.getPath().toString() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []]
    return out


def latest(spark: SparkSession, folder: str, pattern: str = "preprocessed_*") -> str:
    """The last path by name of those that match."""
    found = matching(spark, [f"{folder}/{pattern}"])
    if not found:
        raise FileNotFoundError(f"nothing in {folder} matches {pattern}")
    return max(found)


def months(spark: SparkSession, folder: str, wanted: Sequence[str], pattern: str = "*{month}*") -> DataFrame:
    """Parquet files of the wanted months, found by ``pattern`` in their names; a month without a file is an error."""
    paths = []
    for m in wanted:
        found = matching(spark, [f"{folder}/{pattern.format(month=m)}"])
        if not found:
            raise FileNotFoundError(f"no file of month {m} in {folder}")
        paths += found
    return spark.read.option("mergeSchema", "true").parquet(*sorted(set(paths)))


def chosen(df: DataFrame, columns: Sequence[str], key: str | None = None, values: DataFrame | Sequence | None = None) -> DataFrame:
    """Some columns, and of the rows those whose key is among ``values``: a semi-join, or a filter for a short list."""
    require(df, [*columns, *([key] if key else [])])
    if key and isinstance(values, DataFrame):
        df = df.join(values.select(F.col(values.columns[0]).alias(key)).distinct(), key, "left_semi")
    elif key:
        df = df.where(F.col(key).isin(list(values or [])))
    return df.select(*columns)


def batches(spark: SparkSession, path: str, ts: str = "timestamp", lat: str = "latitude", lon: str = "longitude", callsign: str = "callsign") -> DataFrame:
    """A folder of Parquet batches as one table of points in order of time: unreadable files are skipped, call signs cleaned
    (trimmed, upper case, '' and NAN as null), rows without time or place left out."""
    d = require(parquet_dir(spark, path), [ts, lat, lon])
    if dict(d.dtypes)[ts] == "string":
        d = d.withColumn(ts, parse(F.col(ts)).cast("timestamp_ntz"))
    if callsign in d.columns:
        clean = F.upper(F.trim(callsign))
        d = d.withColumn(callsign, F.when(~clean.isin("", "NAN", "NONE"), clean))
    return d.dropna(subset=[ts, lat, lon]).orderBy(ts)


#: Names that the columns of a track file go by.
TRACK_COLUMNS = {"track": ("trajectory_id", "traj_id", "flight_id", "id"), "t": ("time", "timestamp", "ts"), "x": ("x_utm", "lon", "longitude", "east"), "y": ("y_utm", "lat", "latitude", "north"), "z": ("altitude", "alt", "height")}


def tracks(spark: SparkSession, path: str) -> DataFrame:
    """Tracks of a CSV, Parquet or NPZ file with columns track, x, y and, where there are such, t and z, found by their usual names."""
    refuse_pickles(path)
    if path.endswith(".npz"):
        return npz_tracks(spark, path)
    d = resolve(csv_auto(spark, path) if path.endswith((".csv", ".txt")) else spark.read.parquet(path), TRACK_COLUMNS)
    return require(d, ["track", "x", "y"])


def sniff(spark: SparkSession, path: str, candidates: str = ";,\t|") -> str:
    """The separator that splits the first line most often."""
    line = spark.read.text(path).limit(1).collect()
    text = line[0][0] if line else ""
    return max(candidates, key=text.count)


def csv_auto(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, sniff(spark, path)).drop("_file", "_row")


def head_of_files(df: DataFrame, file: str, ordinal: str, n: int) -> DataFrame:
    """The first ``n`` rows in order of files and rows."""
    return df.orderBy(file, ordinal).limit(n)


def parquet_dir(spark: SparkSession, path: str, skip_corrupt: bool = True) -> DataFrame:
    return spark.read.option("ignoreCorruptFiles", str(skip_corrupt).lower()).option("mergeSchema", "true").parquet(path)


def weather(spark: SparkSession, wind: str, rest: str, year: int | None = None) -> DataFrame:
    """Two ``;`` tables of one station joined by their time stamp (yyyyMMddHHmm), optionally of one year."""
    def one(p: str) -> DataFrame:
        d = spark.read.option("header", True).option("sep", ";").csv(p)
        d = d.select(*[F.col(f"`{c}`").alias(c.strip()) for c in d.columns])
        return d.withColumn("MESS_DATUM", F.try_to_timestamp(F.trim("MESS_DATUM"), F.lit("yyyyMMddHHmm")))

    a, b = one(wind), one(rest)
    b = b.drop(*[c for c in b.columns if c in a.columns and c != "MESS_DATUM"])
    j = a.join(b, "MESS_DATUM")
    return j.where(F.year("MESS_DATUM") == year) if year else j


def noise_map(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """``;`` maps of x, y, z and level, any number at once, with the file each row comes from."""
    schema = "x double, y double, z double, cumulative_res double"
    return spark.read.option("header", True).option("sep", ";").option("enforceSchema", False).schema(schema).csv(paths).withColumn("_file", F.col("_metadata.file_name"))


def workbook(spark: SparkSession, path: str, prefix: str = "MP", needs: Sequence[str] = ("MP", "TLASmax", "Abstand [m]")) -> DataFrame:
    """All sheets whose names start with ``prefix``; each header is the first row that holds ``needs`` (but for MP, the sheet's name).

    Needs pandas' optional spreadsheet engine; such files are small and read on the driver.
    """
    frames = []
    for name, raw in pd.read_excel(path, sheet_name=None, header=None, dtype=str).items():
        if name.startswith(prefix):
            at = next((i for i, row in raw.iterrows() if {n for n in needs if n != "MP"} <= {str(v).strip() for v in row}), None)
            if at is not None:
                d = raw.iloc[at + 1 :].set_axis([str(v).strip() for v in raw.iloc[at]], axis=1).dropna(how="all")
                frames.append(d.assign(MP=d["MP"] if "MP" in d else name))
    if not frames:
        raise ValueError(f"no sheet {prefix}* with a header")
    return spark.createDataFrame(pd.concat(frames, ignore_index=True).astype(object).where(lambda d: d.notna(), None))


def npz_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Tracks of NPZ archives: every array of (points, 2 or 3) as name, x, y, z (0 if missing), with index. No pickles."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    for name in z.files:
                        a = np.atleast_2d(z[name]).astype(float)
                        yield pd.DataFrame({"file": p, "track": name, "idx": np.arange(len(a)), "x": a[:, 0], "y": a[:, 1], "z": a[:, 2] if a.shape[1] > 2 else 0.0})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, track string, idx long, x double, y double, z double")


def refuse_pickles(path: str) -> str:
    """Pickled inputs run code when they are opened; they are refused."""
    if path.endswith((".joblib", ".pkl", ".pickle")):
        raise ValueError(f"{path}: pickled files are not read; convert them to Parquet first")
    return path
