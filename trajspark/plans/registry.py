"""Registry of queries and of the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeops import micros

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column | str, places: int = 6) -> Column:
    """Rounded for comparison, without negative zeros."""
    return F.round(c, places) + F.lit(0.0)


def signed(c: Column, places: int = 6) -> Column:
    """Rounded as SQL's round() does, which keeps the sign of what becomes zero."""
    return F.round(F.abs(c), places) * F.signum(c)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as tracks: flow, flight_id and 32 steps of x, y."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("flow"), F.col("vec_id").alias("flight_id"), F.col("embedding").cast("array<double>").alias("v"))
    pairs = F.transform(F.sequence(F.lit(0), (F.size("v") / 2 - 1).cast("int")), lambda i: F.struct(F.get("v", 2 * i).alias("x"), F.get("v", 2 * i + 1).alias("y")))
    return e.select("flow", "flight_id", F.posexplode(pairs).alias("step", "p")).select("flow", "flight_id", "step", "p.x", "p.y")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("flow"), F.col("vec_id").alias("flight_id"), F.col("embedding").cast("array<double>").alias("v"))


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points: the type is the flow, the user the identity, the value the distance; t is in microseconds."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select("event_id", "ts", micros("ts").alias("t"), F.col("event_type").alias("flow"), F.col("user_id").alias("ident"), F.col("value").alias("dist"), k.alias("k"))


#: The same three views in SQL.
TRACKS = "tracks as (select label as flow, vec_id as flight_id, (i - 1)::int as step, embedding[2 * i - 1]::double as x, embedding[2 * i]::double as y from embeddings, unnest(range(1, 33)) as u(i))"
VECTORS = "vectors as (select label as flow, vec_id as flight_id, list_transform(embedding, lambda x: x::double) as v from embeddings)"
STREAM = "stream as (select event_id, ts, epoch_us(ts) as t, event_type as flow, user_id as ident, value as dist, (props->>'$.k')::bigint as k from events)"
