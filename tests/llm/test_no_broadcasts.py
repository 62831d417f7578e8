"""Near-duplicates by merge joins: no table of a row for each fingerprint or document goes through the driver."""

import random

import pytest

from trajspark.llm import simhash
from trajspark.operators import graph


@pytest.fixture
def plans(spark, monkeypatch):
    """The plans as they ran, of every table that is cut off from its lineage, where Spark may broadcast what it likes."""
    seen, cut = [], simhash.cut

    def kept(df):
        out = cut(df)
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(simhash, "cut", kept)
    monkeypatch.setattr(graph, "cut", kept)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    yield seen
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _docs(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choices(words, k=120) for _ in range(30)]
    rows = [(i, " ".join([*base[i % 30][:119], f"w{i // 30}"])) for i in range(90)]
    return spark.createDataFrame([*rows, (90, rows[0][1]), (91, None)], "doc_id long, text string")


@pytest.mark.parametrize("query", [simhash.near_duplicates, simhash.keep_first])
def test_nothing_is_broadcast(spark, plans, query):
    df = query(_docs(spark))
    assert df.count() == (92 if query is simhash.near_duplicates else df.select("doc_id").distinct().count())
    df.collect()
    ran = [*plans, df._jdf.queryExecution().executedPlan().toString()]
    assert any("SortMergeJoin" in p for p in ran)
    assert not [p for p in ran if "BroadcastHashJoin" in p.split("== Initial Plan ==")[0]]
