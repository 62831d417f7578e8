"""Every query of this subpackage against its SQL; the others must at least run with named columns."""

from __future__ import annotations

import pytest

from trajspark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(name, spark, sf_dir, assert_agrees):
    assert_agrees(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name])


