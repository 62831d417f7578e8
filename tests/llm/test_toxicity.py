"""Scores of toxicity: held-out accuracy, misspellings, gradients, degenerate labels."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from trajspark.llm import toxicity

BAD = ["grobble", "snarvix", "plunkard", "dreckfast"]


def texts(n: int, bad: bool, seed: int) -> list[str]:
    rng = random.Random(seed)
    plain = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(150)]
    out = []
    for _ in range(n):
        words = rng.choices(plain, k=25)
        if bad:
            words[rng.randrange(25)] = rng.choice(BAD)
            words[rng.randrange(25)] = rng.choice(BAD)
        out.append(" ".join(words))
    return out


def test_unseen_misspellings_share_n_grams():
    rng = random.Random(3)
    plain = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(150)]
    make = lambda bad: " ".join(rng.choices(plain, k=25) + ([rng.choice(BAD)] if bad else []))
    y = np.array([i % 2 for i in range(400)])
    score = toxicity.fit([make(bool(b)) for b in y], y).scorer()
    assert np.mean([score(make(True)) >= 0.5 for _ in range(100)]) > 0.9 and np.mean([score(make(False)) < 0.5 for _ in range(100)]) > 0.9
    base = " ".join(plain[:25])
    for word in ("grobbble", "snarvixx", "plunkards", "dreckfasst"):
        assert score(f"{base} {word}") > score(f"{base} {word[::-1]}") and score(f"{base} {word}") > score(base)


def test_gradients_by_finite_differences():
    rng = np.random.default_rng(2)
    ids = [np.array([3, 9, 70]), np.array([9]), np.zeros(0, np.int64), np.array([3, 5, 6, 9])]
    bag = [rng.random(len(x)) / 50 for x in ids]
    b = toxicity._Batch.of(np.arange(4), ids, bag, np.array([0, 1, 1, 0]), np.array([1.0, 2.0, 0.5, 1.0]))
    net = toxicity.Net(rng, np.float64)
    d, d_out, d_bias = net.gradients(b)
    assert b.buckets.tolist() == [3, 5, 6, 9, 70]

    def slope(array, at, h=1e-6):
        array[at] += h
        up = net.loss(b)
        array[at] -= 2 * h
        down = net.loss(b)
        array[at] += h
        return (up - down) / (2 * h)

    for k, u in enumerate(b.buckets):
        for j in range(toxicity.DIM):
            assert d[k, j] == pytest.approx(slope(net.table, (u, j)), rel=1e-4, abs=1e-7)
    for i in range(toxicity.DIM):
        for j in (0, 1):
            assert d_out[i, j] == pytest.approx(slope(net.out, (i, j)), rel=1e-4, abs=1e-7)
    assert d_bias == pytest.approx([slope(net.bias, j) for j in (0, 1)], rel=1e-4)


def test_held_out_accuracy(spark, sf_dir):
    # Labels of these tables err now and then, and a tenth of the documents are toxic.
    top = sf_dir.rsplit("/", 1)[0] + "/sf0.1"
    docs, labels = spark.read.parquet(f"{top}/documents.parquet"), spark.read.parquet(f"{top}/labels.parquet")
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None}
    rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    known = [(r["predicted"], toxic[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in toxic]
    right = [[p == t for p, t in known if t == k] for k in (0, 1)]
    assert all(right) and sum(np.mean(x) for x in right) / 2 > 0.85


@pytest.mark.parametrize(("labels", "want"), [([], 0.0), ([(1, None), (2, None)], 0.0), ([(1, 1), (2, 1), (3, 1)], 1.0), ([(1, 0), (2, 0)], 0.0)])
def test_without_two_classes(spark, labels, want):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", "a b", "c"])], "doc_id long, text string")
    rows = toxicity.score(docs, toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
    assert len(rows) == 4 and all(r["score"] == pytest.approx(want, abs=1e-6) for r in rows)


def test_very_long_and_wordless_texts():
    y = np.array([i % 2 for i in range(60)])
    model = toxicity.fit([t for a, b in zip(texts(30, False, 1), texts(30, True, 2), strict=True) for t in (a, b)], y)
    score = model.scorer()
    assert score(None) == score("") == score(" .,! ") == pytest.approx(1 / (1 + np.exp(-model.bias)))
    one = score("abc grobble")
    assert score("abc grobble " * 50_000) == pytest.approx(one, abs=1e-6)
