"""The pipeline stage by stage against brute force, on real rows and planted ones."""

from __future__ import annotations

import itertools
import os
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from test_llm_methods import brute_fingerprint
from trajspark.llm import line_dedup, packing, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    rows = docs.orderBy("doc_id").collect()
    good = max(rows, key=lambda r: len(set((r["text"] or "").split())))
    body = "\n".join(" ".join(good["text"].split()[i : i + 12]) for i in range(0, 600, 12))
    extra = [
        (90_001, good["text"], good["lang"], "other", good["n_chars"]),
        (90_002, good["text"] + " end", good["lang"], None, None),
        (90_003, None, None, None, None),
        (90_004, "", "en", "hot", 0),
        (90_005, body, "en", "hot", len(body)),
        (90_006, "an own first line here\n" + body + "\nan own last line there", "en", "hot", len(body) + 47),
        (None, body.replace("a", "b"), None, "hot", 1),
        (90_007, " ".join(good["text"].split()[::-1]), "en", "hot", 1),  # near copies without a line in common
        (90_008, " ".join(good["text"].split()[::-1]) + " end", "en", "rare", 1),
    ]
    docs.unionByName(spark.createDataFrame(extra, docs.schema)).repartition(4).write.parquet(f"{top}/documents.parquet")
    return top


@pytest.fixture(scope="module")
def stages(spark, folder):
    """The rows before the first stage and after each."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        found.append(docs.collect())
    return found


def as_rows(rows):
    return Counter(tuple(r[c] for c in COLUMNS) for r in rows)


def test_columns_of_documents_are_kept(stages):
    for rows in stages[:-1]:
        assert list(rows[0].asDict()) == COLUMNS


def test_quality_keeps_what_its_sql_keeps(stages, folder):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    kept = {r[0] for r in con.execute(f"select doc_id from ({quality.oracle()}) where kept").fetchall()}
    assert as_rows(stages[1]) == as_rows(r for r in stages[0] if r["doc_id"] in kept)
    assert 0 < len(stages[1]) < len(stages[0])


def test_line_dedup_removes_repeated_chunks(spark, stages):
    docs = spark.createDataFrame([tuple(r) for r in stages[1]], "doc_id long, text string, lang string, source string, n_chars long")
    chunks = {r["doc_id"]: (r["_chunks"], r) for r in line_dedup.with_chunks(docs).collect()}
    seen: set[str] = set()
    want = Counter()
    for i in sorted(chunks, key=lambda x: -(2**63) if x is None else x):
        parts, r = chunks[i]
        kept = []
        for c in parts:
            if sum(1 for x in c.split("\n") if x.strip(" \t\n\x0b\x0c\r")) >= line_dedup.LEAST_LINES:
                if c in seen:
                    continue
                seen.add(c)
            kept.append(c)
        text = "\n".join(kept)
        if len(kept) == len(parts):
            want[tuple(r[c] for c in COLUMNS)] += 1
        elif text.strip(" "):
            want[r["doc_id"], text, r["lang"], r["source"], len(text)] += 1
    assert as_rows(stages[2]) == want
    assert as_rows(stages[2]) != as_rows(stages[1])


def test_one_of_each_near_duplicate_group_stays(stages):
    rows = stages[2]
    prints = [brute_fingerprint(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            root[find(i)] = find(j)
    first: dict[int, int] = {}
    for i, r in enumerate(rows):
        g = find(i)
        key = lambda k: -(2**63) if rows[k]["doc_id"] is None else rows[k]["doc_id"]
        if g not in first or key(i) < key(first[g]):
            first[g] = i
    assert as_rows(stages[3]) == as_rows(rows[i] for i in first.values())
    assert len(stages[3]) < len(rows)


def test_mixing_keeps_every_row(stages):
    assert as_rows(stages[4]) == as_rows(stages[3])


def test_packing_covers_every_document(stages):
    words = {r["doc_id"]: len((r["text"] or "").split()) for r in stages[4]}
    got = Counter()
    load = Counter()
    for r in stages[5]:
        got[r["doc_id"]] += r["n_tokens"]
        load[r["bucket"], r["batch"]] += max(1, r["bucket"])
        assert r["n_tokens"] <= r["bucket"]
    assert dict(got) == {i: packing_words for i, packing_words in words.items()}
    assert max(load.values()) <= packing.BUDGET


def test_run_gives_the_last_stage_and_removes_the_others(spark, stages, folder):
    from trajspark.llm.common import shared_folder

    got = corpus_pipeline.run(spark, folder).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["n_tokens"], r["bucket"])
    assert Counter(map(key, got)) == Counter(map(key, stages[5]))
    top = shared_folder(spark).removeprefix("file:")
    tables = [x for d in os.listdir(top) if d.startswith("pipeline-") for x in os.listdir(f"{top}/{d}")]
    assert all(t.startswith("3-") for t in tables)
