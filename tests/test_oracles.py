"""Every query of the registry against its SQL; the others must at least run with named columns."""

from __future__ import annotations

import pytest

from trajspark.plans import distances, registry, reports, scores, streams, tables  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_sql(name, spark, sf_dir, assert_agrees):
    assert_agrees(registry.QUERIES[name](spark, sf_dir), registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(name, spark, sf_dir):
    df = registry.QUERIES[name](spark, sf_dir)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0
