"""Repeated queries, and vectors whose squares over- or underflow."""

from __future__ import annotations

import random
from collections import Counter

from trajspark.llm import ann


def test_repeated_queries_and_extreme_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(40)]
    other = [rng.gauss(0, 1) for _ in range(16)]
    schema = "vec_id long, embedding array<double>"
    want = [tuple(r) for r in ann.nearest(spark.createDataFrame(rows, schema), every=40).orderBy("rank").collect()]
    assert [r[:2] for r in want] == [(0, k) for k in range(1, 6)]
    tiny = [(i, [x * 2.0**-600 for x in v]) if i % 3 == 0 else (i, [x * 2.0**600 for x in v]) if i % 3 == 1 else (i, v) for i, v in rows]
    for more in (rows + rows[:1] * 2, tiny + tiny[:1]):
        assert [tuple(r) for r in ann.nearest(spark.createDataFrame(more, schema), every=40).orderBy("rank").collect()] == want
    two = ann.nearest(spark.createDataFrame([*rows, (0, other)], schema), every=40).collect()
    assert Counter(r["rank"] for r in two) == dict.fromkeys(range(1, 6), 2)
