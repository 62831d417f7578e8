"""Shared helpers: lineage cuts, exact distributed ranks, null-safe keys and input guards."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import cut, shared_folder  # noqa: F401  (for the operators beside this file)

#: A word is a maximal run of anything but these six ASCII blanks.
BLANKS = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def texts(column: pa.Array, rows: int = 64) -> Iterator[str | None]:
    """The values of a column of texts, few at a time: Spark bounds a batch by its bytes, and this what Python holds of it."""
    for a in range(0, len(column), rows):
        yield from column.slice(a, rows).to_pylist()


def unused(columns: list[str], name: str) -> str:
    """``name``, or the first of ``name_``, ``name__``, ... that no column bears."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def own(df: DataFrame) -> list[Column]:
    """The columns of ``df`` by their names, whatever is in them."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_of(c: Column) -> Column:
    """A string key that tells null from every value, so that it joins and groups like one."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def shard_bits(n_rows: int, per_shard: int = 25_000, least: int = 6) -> int:
    """Bits of a shard number such that a key holding every row still yields shards of about ``per_shard`` rows."""
    return max(least, (max(1, n_rows) // per_shard).bit_length())


def hash_shard(c: Column, bits: int) -> tuple[Column, Column]:
    """(shard, order) of a pseudo-random global order: the top ``bits`` of an unsigned hash, and the rest of it."""
    h = F.xxhash64(c)
    return F.shiftrightunsigned(h, 64 - bits).cast("int"), F.shiftrightunsigned(F.shiftleft(h, bits), bits)


def distributed_rank(df: DataFrame, keys: list[str], shards: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Exact 0-based rank within ``keys`` without ever sorting one key in one task.

    The order is (``shards``, ``order``). Rows are ranked inside (key, shard); the number of rows in the
    earlier shards of the key comes from a small count table. Keys and shards must not be null.
    ``df`` is read twice, so pass something materialised or cheap.
    """
    by = [*keys, *shards]
    before = Window.partitionBy(*keys).orderBy(*shards).rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).select(*by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = df.withColumn("_local", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    return local.join(offsets, by).withColumn(name, F.col("_before") + F.col("_local")).drop("_before", "_local")
