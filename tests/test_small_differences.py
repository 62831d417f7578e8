"""Queries against their SQL where results differ in a sign or the last digits only."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd

import __spark_entry__ as entry


def _sql(name: str, folder, table: str) -> list[tuple]:
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con.execute(f"select * from ({entry.oracle_sql()[name]}) order by all").fetchall()


def test_point_speeds_between_close_points(spark, tmp_path):
    start = np.datetime64("2024-01-01T00:00:00.123456", "us")
    ts = start + np.cumsum([0, 7, 1, 3, 11, 1_000, 13, 2, 5, 999_999]).astype("timedelta64[us]")
    rows = {"event_id": np.arange(10), "ts": ts, "user_id": 1, "event_type": "view", "value": np.arange(10) * 1e-6, "props": '{"k": 5}'}
    pd.DataFrame(rows).to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    got = sorted(tuple(r) for r in entry.queries()["point_speeds"](spark, str(tmp_path)).collect())
    assert got == _sql("point_speeds", tmp_path, "events")


def test_feature_matrix_keeps_signs_of_zeros(spark, tmp_path):
    v = np.tile([0.25, -1e-7, 1e-7, -0.0, 0.0, -0.5, 2e-7, -4.9e-7], 8).astype(np.float32)
    pd.DataFrame({"vec_id": [1], "embedding": [v], "label": pd.array([0], "int32")}).to_parquet(tmp_path / "embeddings.parquet")
    [got] = entry.queries()["feature_matrix"](spark, str(tmp_path)).collect()
    [want] = _sql("feature_matrix", tmp_path, "embeddings")
    assert repr(tuple(got)) == repr(want)
