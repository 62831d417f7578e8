"""Tool calls and results that share an identifier, and turns without a role: every row comes back."""

from __future__ import annotations

from collections import Counter

from trajspark.llm import chat, queries

GOOD = '{"text":"hi","chars":2}'


def test_every_repeated_call_and_result_is_a_record(spark):
    calls = [("c", 1, "a", None, "brief", GOOD), ("c", 3, "e", "a", "brief", GOOD), ("c", 5, "e", "a", "brief", "{"), ("c", 5, "e", "a", "brief", "{"), ("c", 3, "e", "a", "brief", GOOD),
             ("c", 6, "x", "x", "brief", GOOD), ("c", 7, "x", "x", "brief", GOOD)]
    results = [("c", 2, "a", "ok"), ("c", 4, "a", "late"), ("c", 4, "a", "late"), ("c", 4, "z", None), ("c", 4, "z", None)]
    out = chat.link(
        spark.createDataFrame(calls, "conv_id string, turn int, call_id string, parent_id string, name string, arguments string"),
        spark.createDataFrame(results, "conv_id string, turn int, call_id string, content string"),
        chat.TURN_TOOLS,
        every_row=True,
    ).collect()
    assert Counter((r["call_id"], r["kind"], r["turn"], r["result_turn"], r["depth"], r["status"]) for r in out) == {
        ("a", "call", 1, 2, 0, "ok"): 1, ("e", "call", 3, None, 1, "unanswered"): 1, ("e", "call", 3, None, 1, "duplicate"): 1, ("e", "call", 5, None, 1, "duplicate"): 2,
        ("x", "call", 6, None, None, "cycle"): 1, ("x", "call", 7, None, None, "duplicate"): 1, ("a", "orphan", None, 4, 0, "duplicate"): 2,
        ("z", "orphan", None, 4, 0, "orphan"): 1, ("z", "orphan", None, 4, 0, "duplicate"): 1,
    }
    assert Counter(r["json"] for r in out)['{"id":"a","result":"late"}'] == 2


def test_query_returns_every_turn(spark, tmp_path):
    turns = [("c", 0, "user", "hi"), ("c", 0, "user", "hi"), ("c", 1, "assistant", "yes"), ("c", 1, "assistant", "no"), ("c", 2, None, "who"), ("c", 3, "system", "s")]
    spark.createDataFrame(turns, "conv_id string, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries.op6_tool_linking(spark, str(tmp_path)).collect()
    assert Counter((r["call_id"], r["status"]) for r in out) == {("t0", "ok"): 1, ("t0", "duplicate"): 2, ("t2", "orphan"): 1, ("t3", "orphan"): 1}
    assert '{"id":"t2","result":"who"}' in {r["json"] for r in out}
