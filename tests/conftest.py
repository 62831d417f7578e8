"""One small session for all tests, and how results are compared."""

from __future__ import annotations

import math
import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, [os.environ.get("PYTHONPATH")])])
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from trajspark.session import build

    session = build(
        "local[8]",
        "tests",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    """A value that sorts and compares: floats to nine significant digits, timestamps as text."""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def as_rows(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def alike(a, b) -> bool:
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-7)
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(alike, a, b))
    return a == b


@pytest.fixture(scope="session")
def assert_agrees(sf_dir):
    """Compare a DataFrame with what DuckDB gets from the same files."""
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")

    def check(df, sql: str) -> None:
        found = con.execute(sql)
        names = [c[0] for c in found.description]
        want = as_rows(names, found.fetchall())
        assert sorted(df.columns) == sorted(names)
        got = as_rows(df.columns, [tuple(r) for r in df.collect()])
        assert len(got) == len(want)
        bad = [(g, w) for g, w in zip(got, want, strict=True) if not alike(g, w)]
        assert not bad, f"{len(bad)} rows differ, first: {bad[0]}"

    return check
