"""Corpus operators against brute force, on a small fixture of nulls, ties, repeats, long texts and clashing columns."""

from __future__ import annotations

import base64
import itertools
import random
import urllib.parse
import zlib

import numpy as np
import pytest
import xxhash

from trajspark.llm import ann, chat, langid, line_dedup, mixing, packing, quality, secrets, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, count long, rank string, _id string"


def _texts() -> list[str | None]:
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    plain = [" ".join(rng.choices(words, k=120)) for _ in range(25)]
    near = [plain[0] + " x", plain[1].replace("w1", "w2", 1), plain[0], plain[0]]
    lines = "\n".join(f"shared line {i} with words" for i in range(40))
    return [None, "", " \n\t", "one", "Two Words", *plain, *near, lines, plain[3] + "\n" + lines, " ".join(plain * 40)]


@pytest.fixture(scope="module")
def docs(spark):
    texts = _texts()
    rows = [(i, t, (None, "en", "de")[i % 3], (None, "hot", "hot", "rare")[i % 4], len(t or ""), i, "r", "c") for i, t in enumerate(texts)]
    rows += [rows[6], (None, "null id", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_fingerprint(text: str | None) -> int:
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ")
    w = [x for x in w if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(docs):
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
            root[find(i)] = find(j)
    order = lambda x: -(2**63) if x is None else x
    least: dict[int, object] = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d, key=order) if find(i) in least else d
    want = sorted(((d, f"{f:016x}", least[find(i)]) for i, (d, f) in enumerate(rows)), key=repr)
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == want


def test_simhash_links_find_every_pair(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = set(base) | {b ^ sum(1 << k for k in rng.sample(range(64), n)) for b in base for n in (1, 2, 3, 4)}
    hot = rng.getrandbits(32) << 32
    prints |= {hot | rng.getrandbits(32) for _ in range(700)} | {hot | 1 << k for k in range(20)}  # a hot segment
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    got = {(r["u"], r["v"]) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    want = {(max(a, b), min(a, b)) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert got == want


def test_mixing_stays_within_a_block():
    units = mixing.default_units({"a": 900, "b": 90, "c": 10}, resolution=60)
    slots = mixing.period(units)
    q = sum(units.values())
    assert sorted(itertools.chain(*slots.values())) == list(range(q))
    for s, at in slots.items():
        for t in range(q + 1):
            assert abs(sum(x < t for x in at) - t * units[s] / q) < 1


def test_mixing_keeps_every_row(docs):
    out = mixing.mix(docs, block=4).collect()
    assert len(out) == docs.count() and len({(r["slot"], r["block_pos"]) for r in out}) == len(out)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in out)


def test_nearest_recall(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    bad = spark.createDataFrame([(10_000, None), (10_001, [0.0] * 64), (10_002, [float("nan")] * 64), (None, [1.0] * 64)], e.schema)
    rows = e.orderBy("vec_id").collect()
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    x /= np.sqrt((x * x).sum(1))[:, None]
    got: dict[int, list] = {}
    for r in ann.nearest(e.unionByName(bad)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        s[i] = -9
        want = ids[np.lexsort((ids, -s))[:5]].tolist()
        hits, total = hits + len(set(want) & set(got[ids[i]])), total + 5
    assert sorted(got) == sorted(ids[ids % 50 == 0].tolist()) and hits / total >= 0.9


def test_secrets_in_nested_layers():
    inner = "password = hunter2hunter2"
    b64 = base64.b64encode(zlib.compress(inner.encode())).decode()
    twice = urllib.parse.quote(base64.b64encode(inner.encode()).decode(), safe="")
    text = f"a {b64} b {twice} c \\u0074oken: ABCDEFGH12 AKIA{'Z' * 12} {'0af' * 12} token=short"
    base, every, layers, refused = secrets.scan(text)
    assert [k for *_, k in base] == ["access", "hex"] and layers >= 4 and refused == 0
    found = {text[a:b] for a, b, k in every if k == "assign"}
    assert b64 in found and "\\u0074oken: ABCDEFGH12" in found
    assert any(twice.startswith(t) or t.startswith(twice[:20]) for t in found)
    assert secrets.scan(None) == ([], [], 0, 0)


def test_boundaries_are_optimal():
    rng = random.Random(2)
    for _ in range(30):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 8)))
        counts = [rng.randint(1, 9) for _ in lengths]
        pad = lambda tops: sum(c * next(t for t in tops if t >= x) for x, c in zip(lengths, counts, strict=True))
        for k in (1, 2, 3):
            best = min(pad(t) for n in range(1, k + 1) for t in itertools.combinations(lengths, n) if t[-1] == lengths[-1])
            assert pad(packing.boundaries(lengths, counts, k)) == best


def test_packing_covers_every_token(docs):
    out = packing.pack(docs, seq_len=50, buckets=4, budget=200).collect()
    assert sum(r["n_tokens"] for r in out) == sum(len((r["text"] or "").split()) for r in docs.collect())
    load: dict[tuple, int] = {}
    for r in out:
        assert r["n_tokens"] <= r["bucket"]
        load[r["bucket"], r["batch"]] = load.get((r["bucket"], r["batch"]), 0) + r["bucket"]
    assert max(load.values()) <= 200 and len({(r["bucket"], r["batch"], r["batch_pos"]) for r in out}) == len(out)


def test_line_dedup_removes_only_repeats(docs):
    out = {(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert (0, None) in out and (1, "") in out and (34, texts[34]) in out
    assert any(d == 35 and len(t) < len(texts[35]) for d, t in out)


def test_tool_links_flag_cycles_duplicates_and_orphans(spark):
    good = '{"text":"hi","chars":2}'
    calls = [("c", 1, "a", None, "brief", good), ("c", 3, "b", "a", "brief", "{"), ("c", 5, "x", "y", "brief", good), ("c", 6, "y", "x", "brief", good),
             ("c", 7, "d", None, "other", good), ("c", 8, "e", None, "brief", good), ("c", 9, "e", None, "brief", good), (None, 1, "a", None, "brief", good)]
    results = [("c", 2, "a", "ok"), ("c", 4, "zz", "late"), (None, 2, "a", "x")]
    out = chat.link(
        spark.createDataFrame(calls, "conv_id string, turn int, call_id string, parent_id string, name string, arguments string"),
        spark.createDataFrame(results, "conv_id string, turn int, call_id string, content string"),
        chat.TURN_TOOLS,
    ).collect()
    status = {(r["conv_id"], r["call_id"]): (r["status"], r["depth"]) for r in out if r["conv_id"]}
    assert status == {
        ("c", "a"): ("ok", 0), ("c", "b"): ("invalid:json", 1), ("c", "x"): ("cycle", None), ("c", "y"): ("cycle", None),
        ("c", "d"): ("invalid:tool", 0), ("c", "e"): ("duplicate", 0), ("c", "zz"): ("orphan", 0),
    }
    assert [r["json"] for r in out if r["call_id"] == "a" and r["conv_id"]] == ['{"arguments":{"chars":2,"text":"hi"},"id":"a","name":"brief","result":"ok"}']
    assert len(out) == 9


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    langs = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = [r for r in langid.predict(docs, langid.train(docs)).collect() if r["held_out"] and langs[r["doc_id"]]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in rows) / len(rows) > 0.8


def test_every_operator_takes_the_fixture_and_an_empty_table(spark, docs, empty):
    labels = spark.createDataFrame([(6, 1), (7, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    n = docs.count()
    for d, size in ((docs, n), (empty, 0)):
        assert toxicity.score(d, toxicity.train(d, labels)).count() == size
        assert langid.predict(d, langid.train(d)).count() == size
        assert quality.quality_rules(d).count() == size
        assert secrets.find_secrets(d).count() == size
        assert mixing.mix(d).count() == size
        assert line_dedup.dedup_lines(d).count() == size
        assert packing.pack(d).select("doc_id").distinct().count() == min(size, n - 1)
        assert simhash.keep_first(d).columns == d.columns
        assert quality.keep_good(d).columns == d.columns
    assert simhash.near_duplicates(empty).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(vectors).count() == 0
