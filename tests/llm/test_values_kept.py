"""What operators must not lose or overwrite: clashing columns, repeated rows, exact weights, rare languages, session settings."""

from __future__ import annotations

import itertools
import random
import time
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from trajspark.llm import ann, chat, langid, line_dedup, mixing, packing, quality, simhash

#: Names that operators use themselves, in their results or on the way.
CLASHES = (
    "_k _h key text_hash lk sk kept n_words _words _lines _windows id hash n fp row k h hits gone out first chunk _chunks _hashes _ends _here _text "
    "slot block block_pos phase release deadline _source _shard _order _rank _from _to _start _q _p _slots _round _at _wide _before _local _n"
).split()


def good_text(seed: int, words: int = 90) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(words))


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, good_text(i) + f"\nline {i} a b\n" + "\n".join(f"shared {k}" for k in range(6)), "en", "s" if i % 2 else None, i, *[f"{c}{i}" for c in CLASHES]) for i in range(24)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)).repartition(3).cache()


@pytest.mark.parametrize("operator", [quality.keep_good, mixing.in_mixed_order, simhash.keep_first, line_dedup.dedup_lines])
def test_clashing_columns_keep_their_values(clashing, operator):
    out = operator(clashing)
    assert out.columns[: len(clashing.columns)] == clashing.columns
    rows = out.collect()
    assert len(rows) == 24
    for r in rows:
        assert [r[c] for c in CLASHES] == [f"{c}{r['doc_id']}" for c in CLASHES]


def test_names_of_results_win_in_mix_only(clashing):
    r = mixing.mix(clashing).first()
    assert isinstance(r["slot"], int) and r["_rank"].startswith("_rank")


def test_session_settings_stay(spark, clashing):
    before = {r[0]: r[1] for r in spark.sql("set").collect()}
    simhash.near_duplicates(clashing).count()
    langid.predict(clashing, langid.train(clashing)).count()
    assert {r[0]: r[1] for r in spark.sql("set").collect()} == before


def test_one_row_of_repeated_rows_stays(spark):
    a, b = good_text(1), good_text(2)
    rows = [(1, a, "x"), (1, a, "x"), (1, a, "y"), (1, b, "z"), (2, a, "w"), (None, b, "u"), (None, b, "u"), (None, "", "e"), (7, "", "e"), (7, None, "e")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = simhash.keep_first(d).collect()
    assert Counter((r["doc_id"], r["text"] if r["text"] else "") for r in kept) == {(1, a): 1, (None, b): 1, (None, ""): 1}


@pytest.mark.parametrize("weights", [{"a": 1, "b": 2}, {"a": 0.99999, "b": 0.00001}, {"a": Fraction(1, 3), "b": Fraction(1, 7), "c": Fraction(2, 11)}, {"a": 0.5, "b": 0.25, "c": 0.125, "d": 0.125}])
def test_mixing_follows_the_callers_weights(weights):
    n = 1_000_000
    exact = {s: Fraction(str(w)) / sum(Fraction(str(x)) for x in weights.values()) for s, w in weights.items()}
    target = mixing.targets({"=" + s: 10**9 for s in weights}, weights)
    rows = mixing.plan({"=" + s: 10**9 for s in weights}, target)
    ahead = np.arange(n + 1)
    total = np.zeros(n + 1, np.int64)
    for s, share in exact.items():
        _, _, a, _, start, q, p, slots = next(r for r in rows if r[0] == "=" + s)
        assert (a, start) == (0, 0)
        at = (np.arange(-(-n // q) + 1)[:, None] * q + np.array(slots)[None, :]).ravel()
        done = np.concatenate(([0], np.cumsum(np.bincount(at[at < n], minlength=n))))
        # |done - t * num / den| < 1, in integers
        assert (np.abs(done * share.denominator - ahead * share.numerator) < share.denominator).all()
        total += done
    assert (total == ahead).all()


def test_mixing_is_earliest_deadline_first_by_brute_force(spark):
    sizes, weights = {"a": 61, "b": 7, "c": 20}, {"a": 0.45, "b": 0.35, "c": 0.2}
    rows = [(i, s) for i, s in enumerate(itertools.chain(*[[s] * n for s, n in sizes.items()]))]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, block=3).collect()
    order = [(r["source"], r["block"]) for r in sorted(out, key=lambda r: (r["slot"], r["block_pos"])) if r["block_pos"] == 0]
    left, done, want = {s: -(-n // 3) for s, n in sizes.items()}, dict.fromkeys(sizes, 0), []
    while left:
        w = {s: Fraction(str(weights[s])) for s in left}
        total, count, t = sum(w.values()), dict.fromkeys(left, 0), 0
        while all(n > 0 for n in left.values()):
            ready = [(-((-(count[s] + 1) * total) // w[s]), s) for s in left if count[s] * total // w[s] <= t]
            s = min(ready)[1]
            want.append((s, done[s]))
            count[s], done[s], left[s], t = count[s] + 1, done[s] + 1, left[s] - 1, t + 1
        left = {s: n for s, n in left.items() if n}
    assert order == want
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in out)


def test_partial_zero_and_too_fine_weights(spark):
    t = mixing.targets({"=a": 100, "=b": 100, "null": 400}, {"a": 0.3, "b": 0.1})
    assert t["=a"] == 3 * t["=b"] and t["null"] / sum(t.values()) == Fraction(1, 2)
    rows = [(i, s) for i, s in enumerate("aaabbbccc")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), {"a": 1, "b": 1, "c": 0}, block=1).orderBy("slot").collect()
    assert len(out) == 9 and [r["source"] for r in out[-3:]] == ["c"] * 3
    with pytest.raises(ValueError, match="fewer digits"):
        mixing.plan({"=a": 10**12, "=b": 10**12}, {"=a": Fraction(1, 10**9 + 7), "=b": Fraction(1)})
    with pytest.raises(ValueError, match="negative"):
        mixing.targets({"=a": 1}, {"a": -1})


def test_language_of_long_texts_is_learned(spark):
    rng = random.Random(9)
    make = lambda letters, n: " ".join("".join(rng.choices(letters, k=5)) for _ in range(n))
    rows = [(i, make("abcde", 30), "xx") for i in range(200)] + [(1_000 + i, make("vwxyz", 30), "yy") for i in range(200)] + [(2_000 + i, make("klmno", 4_000), "zz") for i in range(6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    chosen, langs = langid.sample(d, chars=30_000)
    assert set(langs) == {"xx", "yy", "zz"} and langs.count("zz") == langid.LEAST_TEXTS
    model = langid.train(d)
    assert model.languages == ["xx", "yy", "zz"] and model.predict(make("klmno", 20))[0] == "zz"
    assert (model.weights == 0).mean() > 0.9  # by the L1 penalty
    import pickle

    again = pickle.loads(pickle.dumps(model))
    assert np.array_equal(again.weights, model.weights) and len(pickle.dumps(model)) < 1_500_000


def test_many_languages_are_all_learned(spark):
    rows = [(1_000 * k + i, chr(0x4E00 + 7 * k) * 3 + " " + chr(0x4E00 + 7 * k + 1) * 2, f"l{k:03d}") for k in range(300) for i in range(6)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=4)
    assert len(model.languages) == 300


@pytest.mark.parametrize("step", [1, 2, 3, 7, 50])
def test_counts_do_not_depend_on_stretches(monkeypatch, step):
    texts = ["", "a", "Ab  cd", "éß über 12 drei", good_text(3), " x" * 20]
    want = [langid.counts(t) for t in texts]
    monkeypatch.setattr(langid, "_STEP", step)
    for t, w in zip(texts, want, strict=True):
        got = langid.counts(t)
        assert (got is None) == (w is None) and (w is None or np.array_equal(got, w))


def test_ftrl_and_temperature_against_plain_loops():
    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.choice(50, 6, replace=False)), rng.random(6)) for _ in range(40)]
    y = rng.integers(0, 3, 40)
    w, bias = langid.ftrl(rows, y, 3, epochs=2, seed=5)
    z, n = np.zeros((langid.BUCKETS + 1, 3)), np.zeros((langid.BUCKETS + 1, 3))

    def weight(i, k):
        if abs(z[i, k]) <= langid.L1:
            return 0.0
        return -(z[i, k] - np.sign(z[i, k]) * langid.L1) / ((langid.BETA + n[i, k] ** 0.5) / langid.ALPHA + langid.L2)

    order = np.random.default_rng(5)
    for _ in range(2):
        for r in order.permutation(40):
            x = [*zip(rows[r][0].tolist(), rows[r][1].tolist(), strict=True), (langid.BUCKETS, 0.1)]
            ws = {(i, k): weight(i, k) for i, _ in x for k in range(3)}
            s = np.array([sum(v * ws[i, k] for i, v in x) for k in range(3)])
            p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
            for i, v in x:
                for k in range(3):
                    g = v * (p[k] - (k == y[r]))
                    sigma = ((n[i, k] + g * g) ** 0.5 - n[i, k] ** 0.5) / langid.ALPHA
                    z[i, k] += g - sigma * ws[i, k]
                    n[i, k] += g * g
    want = np.array([[weight(i, k) for k in range(3)] for i in range(50)])
    assert np.allclose(w[:50], want) and np.allclose(bias, [0.1 * weight(langid.BUCKETS, k) for k in range(3)])
    logits = rng.normal(size=(200, 3)) * 4
    labels = np.array([rng.choice(3, p=langid.softmax(x / 2.5)) for x in logits])
    grid = np.exp(np.linspace(-4, 3, 4_001))
    loss = [-np.log(langid.softmax(logits / t)[np.arange(200), labels]).mean() for t in grid]
    assert langid.calibrate(logits, labels) == pytest.approx(grid[int(np.argmin(loss))], rel=0.01)


def test_numbers_of_canonical_json(spark):
    args = ['{"b":1.0,"a":[1e2,-0,0.50,2.5e-3,{"z":null,"y":"1.0 \\"2.0\\\\"}],"c":"\\\\"}', '{"c":"\\\\","a":[100,0,5e-1,0.0025,{"y":"1.0 \\"2.0\\\\","z":null}],"b":1}', '{"x":1e-11,"y":10000000000000000000000}', '{"y":1e22,"x":0.00000000001}', None, "{"]
    calls = spark.createDataFrame([("c", i, f"k{i}", None, "free", a) for i, a in enumerate(args)], "conv_id string, turn int, call_id string, parent_id string, name string, arguments string")
    none = spark.createDataFrame([], "conv_id string, turn int, call_id string, content string")
    out = {r["call_id"]: (r["json"].replace(f'"id":"{r["call_id"]}"', '"id":"k"'), r["status"]) for r in chat.link(calls, none, {"free": {}}).collect()}
    assert out["k0"] == out["k1"] == ('{"arguments":{"a":[100,0,0.5,0.0025,{"y":"1.0 \\"2.0\\\\","z":null}],"b":1,"c":"\\\\"},"id":"k","name":"free"}', "unanswered")
    assert out["k2"] == out["k3"]
    assert out["k4"] == out["k5"] == ('{"id":"k","name":"free"}', "invalid:json")


def test_empty_calls_and_extra_columns(spark):
    calls = spark.createDataFrame([], "conv_id string, turn int, call_id string, parent_id string, name string, arguments string, json string")
    results = spark.createDataFrame([("c", 1, "a", "x", 3)], "conv_id string, turn int, call_id string, content string, depth int")
    assert [(r["kind"], r["depth"], r["json"]) for r in chat.link(calls, results, chat.TURN_TOOLS, every_row=True).collect()] == [("orphan", 0, '{"id":"a","result":"x"}')]
    assert chat.link(calls, results.limit(0), chat.TURN_TOOLS).count() == 0


def brute_nearest(ids, x, every=50, top=5):
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = unit @ unit[i]
        s[ids == ids[i]] = -9
        out[int(ids[i])] = ids[np.lexsort((ids, -s))[:top]].tolist()
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_neighbours_at_larger_sizes_and_in_several_passes(spark, sf_dir, sf):
    e = spark.read.parquet(f"{sf_dir.rsplit('/', 1)[0]}/{sf}/embeddings.parquet")
    rows = e.select("vec_id", "embedding").collect()
    want = brute_nearest(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float))
    for size in (ann.QUERY_BYTES, 40_000):
        got: dict[int, list] = {}
        for r in ann.nearest(e, query_bytes=size).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        hits = sum(len(set(got[q]) & set(w)) for q, w in want.items())
        assert got.keys() == want.keys() and hits >= 0.9 * sum(map(len, want.values()))


def test_ties_repeats_and_lengths_of_vectors(spark):
    rows = [(0, [1.0, 0.0], "a"), (5, [2.0, 0.0], "b"), (3, [4.0, 0.0], "c"), (3, [4.0, 0.0], "d"), (2, [0.0, 1.0], "e"), (9, [1e-200, 0.0], "f"), (50, [1.0, 2.0, 3.0], "g"), (51, [1.0, 2.0], "h")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    out = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(d).orderBy("query_id", "rank").collect()]
    assert out == [(0, 1, 3), (0, 2, 3), (0, 3, 5), (0, 4, 9), (0, 5, 51)]


def test_line_dedup_of_a_long_text_and_its_copy(spark):
    def run(n):
        text = "\n".join(f"line {i} of the long text" for i in range(n))
        d = spark.createDataFrame([(1, text), (2, text), (3, text + "\nend of it")], "doc_id long, text string")
        start = time.perf_counter()
        out = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed_lines"]) for r in line_dedup.dedup_lines(d).collect()}
        return time.perf_counter() - start, text, out

    run(2_000)
    short, _, _ = run(10_000)
    long, text, out = run(80_000)
    assert out[1] == (text, 80_000, 0) and out[2][1] == 80_000 and out[2][2] > 50_000
    assert long < 8 * max(short, 1) * 2  # not the square


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(4)
    pool = [f"common {i} line" for i in range(12)] + ["", " ", "x"]
    texts = [None, "", *["\n".join(rng.choices(pool, k=rng.randint(1, 25))) for _ in range(60)]]
    d = spark.createDataFrame([(i if i % 9 else None, t) if i == 9 else (i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    chunked = {r["doc_id"]: r["_chunks"] for r in line_dedup.with_chunks(d).collect()}
    seen: set[str] = set()
    want = {}
    for i in sorted(chunked, key=lambda x: -1 if x is None else x):
        kept = []
        for c in chunked[i] or []:
            if sum(1 for x in c.split("\n") if x.strip(" \t\n\x0b\x0c\r")) >= line_dedup.LEAST_LINES:
                if c in seen:
                    continue
                seen.add(c)
            kept.append(c)
        want[i] = None if chunked[i] is None else "\n".join(kept)
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(d).collect()} == want


def test_packing_of_null_ids_ties_and_a_very_long_text(spark):
    rows = [(None, "a b"), (None, "a b"), (3, "w " * 10_000), (3, "c d e"), (4, None), (5, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = packing.pack(d, seq_len=64, buckets=3, budget=256).collect()
    assert sum(r["n_tokens"] for r in out) == 2 + 2 + 10_000 + 3 and sum(r["n_tokens"] == 0 for r in out) == 2
    assert len({(r["bucket"], r["batch"], r["batch_pos"]) for r in out}) == len(out)
    starts = sorted(r["start"] for r in out if r["doc_id"] == 3 and r["n_tokens"] > 3)
    assert starts == [64 * k for k in range(157)]


def test_short_passages_between_private_lines_go(spark):
    rng = random.Random(8)
    line = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n))
    private = lambda: "\n".join(line(rng.randint(4, 9)) for _ in range(rng.randint(2, 9)))
    passages = ["\n".join(line(30) for _ in range(n)) for n in (2, 3, 4, 5)] + [line(60)]
    texts, own_lines = [], []
    for i in range(40):
        parts = [private(), passages[i % 5], private()] if i % 7 else [private(), passages[i % 5], passages[(i + 1) % 5], private()]
        texts.append("\n".join(parts))
        own_lines.append("\n".join(p for p in parts if p not in passages))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(d, passages=True).collect()}
    seen: set[str] = set()
    for i in range(40):
        assert set(own_lines[i].split("\n")) <= set(out[i].split("\n"))  # private lines stay
        for p in passages:
            if p in texts[i]:
                assert (p in out[i]) == (p not in seen)
                seen.add(p)


@pytest.mark.parametrize("passages", [False, True])
def test_line_dedup_of_odd_texts(spark, passages):
    rows = [(1, None), (2, ""), (3, "\n\n\n"), (4, "\n\n\n"), (5, "a\nb"), (6, "a\nb"), (None, "a\nb"), (7, "x " * 60), (8, "x " * 60), (9, "a\nb"), (9, "a\nb\nc")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = [(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(d, passages=passages).collect()]
    assert len(out) == len(rows) and {(1, None), (2, ""), (3, "\n\n\n"), (4, "\n\n\n"), (None, "a\nb"), (7, "x " * 60)} <= set(out)
    assert ((8, "") in out) == passages
    assert line_dedup.dedup_lines(d.limit(0), passages=passages).count() == 0
