"""Toxicity from subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams between boundary marks, and of itself, hashed into
``BUCKETS`` rows of one embedding table. A document is the mean of its words' vectors, and a linear
softmax of it gives the two classes' probabilities; table and classifier are trained together, so
an unseen misspelling lands near the words whose n-grams it shares. As all is linear up to the
softmax, the trained model boils down to one weight for each bucket, by which words are scored once
and remembered.

The classifier is fitted on a bounded sample: the ``SAMPLE`` labelled documents of smallest hash of
each class, whole texts, up to ``SAMPLE_CHARS`` characters of each. A tenth of it is held back, and
training stops when the loss on that part has not fallen for ``PATIENCE`` epochs. Labels err, so their
targets are smoothed, and n-grams of fewer than ``LEAST_TEXTS`` sampled texts are not learned. Every
document is scored over its whole text.

Defined results. Null and empty texts, or ones without a word, score the classifier's bias alone.
A document with several labels counts as toxic if any label says so; null labels are ignored.
Without two classes to learn from, the score is the share of toxic labels, or 0 without any.
A very long text is scored whole. Repeated rows get equal scores; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts as texts_of

BUCKETS = 1 << 16
DIM = 8
GRAMS = (3, 4, 5)
#: Labelled documents of each class that the fit may use; bounds the driver's work and memory.
SAMPLE = 2_000
#: Characters of sampled texts of each class; documents are taken whole until they are used up.
SAMPLE_CHARS = 6_000_000
EPOCHS = 30
PATIENCE = 5
HELD_BACK = 0.1
#: Share of a label's weight that its target gives to the other class.
SMOOTHING = 0.05
LEAST_TEXTS = 3
RATE = 0.05
BATCH = 32
#: L2 penalty of the table's touched rows: keeps chance n-grams of few documents small.
DECAY = 3e-4
#: Means over many words are small; this brings them to the scale of the softmax's weights.
SCALE = np.float32(200)
SEED = 7
FOLDS = 5
_WORDS_KEPT = 200_000
_ASCII = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by ``FOLDS``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8: runs of ASCII letters and digits and of anything beyond ASCII."""
    return (text or "").lower().encode("utf-8", "replace").translate(_ASCII).split()


def buckets_of(word: bytes, buckets: int = BUCKETS) -> list[int]:
    w = b"<" + word + b">"
    crc = zlib.crc32
    return [crc(w) % buckets] + [crc(w[i : i + n]) % buckets for n in GRAMS for i in range(len(w) - n + 1)]


@dataclass
class Model:
    """Logit of the toxic class = bias + mean over words of the mean weight of their buckets."""

    weights: np.ndarray
    bias: float

    def scorer(self):
        known: dict[bytes, float] = {}
        w = self.weights

        def score(text: str | None) -> float:
            words = words_of(text)
            total = 0.0
            for x in words:
                v = known.get(x)
                if v is None:
                    if len(known) >= _WORDS_KEPT:
                        known.clear()
                    b = buckets_of(x, len(w))
                    v = known[x] = float(w[b].sum() / len(b))
                total += v
            z = self.bias + (total / len(words) if words else 0.0)
            return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))

        return score


def _bags(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each text's distinct buckets and their weights, which add up to 1."""
    cache: dict[bytes, list[int]] = {}
    ids, weights = [], []
    for t in texts:
        words = words_of(t)
        at, w = [], []
        for x in words:
            b = cache.get(x)
            if b is None:
                b = cache[x] = buckets_of(x)
            at += b
            w += [1 / len(b)] * len(b)
        if words:
            u, inv = np.unique(np.array(at, np.int32), return_inverse=True)
            ids.append(u)
            weights.append((np.bincount(inv, np.array(w)) / len(words)).astype(np.float32))
        else:
            ids.append(np.zeros(0, np.int32))
            weights.append(np.zeros(0, np.float32))
    return ids, weights


@dataclass
class _Batch:
    """Texts as one sparse matrix, by rows for the forward pass and by buckets for the backward one."""

    y: np.ndarray
    weight: np.ndarray
    at: np.ndarray
    w: np.ndarray
    row: np.ndarray
    order: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, part: np.ndarray, ids: list[np.ndarray], bag: list[np.ndarray], labels: np.ndarray, weigh: np.ndarray) -> _Batch:
        at = np.concatenate([ids[i] for i in part])
        row = np.repeat(np.arange(len(part)), [len(ids[i]) for i in part])
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        return cls(labels[part], weigh[part], at, np.concatenate([bag[i] for i in part]), row, order, first)

    @property
    def buckets(self) -> np.ndarray:
        return self.at[self.order][self.first]


class Net:
    """The table and the softmax, with the gradients of their weighted cross-entropy."""

    def __init__(self, rng: np.random.Generator, kind: type = np.float32):
        self.table = (rng.standard_normal((BUCKETS, DIM)) * 0.02).astype(kind)
        self.out = (rng.standard_normal((DIM, 2)) * 0.1).astype(kind)
        self.bias = np.zeros(2, kind)

    def forward(self, b: _Batch) -> tuple[np.ndarray, np.ndarray]:
        """(mean vectors, probabilities)."""
        x = np.zeros((len(b.y), DIM), self.table.dtype)
        some = np.flatnonzero(np.diff(b.row, prepend=-1))
        if len(some):
            x[b.row[some]] = np.add.reduceat(self.table[b.at] * b.w[:, None], some, axis=0)
        x *= SCALE
        z = x @ self.out + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        return x, p / p.sum(1, keepdims=True)

    @staticmethod
    def targets(b: _Batch) -> np.ndarray:
        t = np.full((len(b.y), 2), SMOOTHING, np.float32)
        t[np.arange(len(b.y)), b.y] = 1 - SMOOTHING
        return t

    def loss(self, b: _Batch) -> float:
        p = self.forward(b)[1]
        return float(-(b.weight[:, None] * self.targets(b) * np.log(p + 1e-12)).sum() / len(b.y))

    def gradients(self, b: _Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the touched rows of the table, of the softmax, of its bias."""
        x, p = self.forward(b)
        g = (p - self.targets(b)) * (b.weight / len(b.y))[:, None]
        d_x = (g @ self.out.T) * SCALE
        d = np.add.reduceat((b.w[:, None] * d_x[b.row])[b.order], b.first, axis=0) if len(b.first) else np.zeros((0, DIM), x.dtype)
        return d, x.T @ g, g.sum(0)


def fit(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Adagrad on the cross-entropy of both the table and the softmax; classes weigh alike."""
    rng = np.random.default_rng(seed)
    ids, bag = _bags(texts)
    common = np.bincount(np.concatenate(ids), minlength=BUCKETS) >= LEAST_TEXTS
    for k, at in enumerate(ids):
        ids[k], bag[k] = at[common[at]], bag[k][common[at]]
    mixed = rng.permutation(len(texts))
    aside = np.zeros(len(texts), bool)
    for c in (0, 1):
        of = mixed[labels[mixed] == c]
        aside[of[: int(len(of) * HELD_BACK)]] = True
    learn = mixed[~aside[mixed]]
    share = np.bincount(labels[learn], minlength=2) / len(learn)
    weigh = (0.5 / share)[labels].astype(np.float32)
    batches = [_Batch.of(learn[a : a + BATCH], ids, bag, labels, weigh) for a in range(0, len(learn), BATCH)]
    held = _Batch.of(np.flatnonzero(aside), ids, bag, labels, weigh) if aside.any() else None
    net = Net(rng)
    sums = [np.full(BUCKETS, 1e-8, np.float32), np.full_like(net.out, 1e-6), np.full_like(net.bias, 1e-6)]
    best, least, since = None, np.inf, 0
    for epoch in range(epochs):
        rate = RATE * (1 - 0.9 * epoch / epochs)
        for k in rng.permutation(len(batches)):
            u = batches[k].buckets
            d, d_out, d_bias = net.gradients(batches[k])
            d += DECAY * net.table[u]
            sums[0][u] += (d * d).mean(1)
            net.table[u] -= rate * d / np.sqrt(sums[0][u])[:, None]
            for value, total, step in ((net.out, sums[1], d_out), (net.bias, sums[2], d_bias)):
                total += step**2
                value -= (rate * step / np.sqrt(total)).astype(np.float32)
        if held is None:
            continue
        loss = net.loss(held)
        since += 1
        if loss < least:
            best, least, since = (net.table.copy(), net.out.copy(), net.bias.copy()), loss, 0
        elif since >= PATIENCE:
            break
    table, out, bias = best or (net.table, net.out, net.bias)
    return Model((table @ ((out[:, 1] - out[:, 0]) * SCALE)).astype(np.float32), float(bias[1] - bias[0]))


def sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Whole texts and labels of the learning fold: of each class the ``per_class`` of smallest hash."""
    y = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    y = y.where(~held_out(F.col("doc_id"))).withColumn("o", F.xxhash64("doc_id"))
    picked = y.where("y = 1").orderBy("o", "doc_id").limit(per_class).unionByName(y.where("y = 0").orderBy("o", "doc_id").limit(per_class))
    joined = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most 2 x per_class rows
    texts, found, used = [], [], [0, 0]
    for r in joined.orderBy("o", "doc_id").toLocalIterator():
        n = len(r["text"] or "")
        if used[r["y"]] + n > SAMPLE_CHARS:
            continue
        used[r["y"]] += n
        texts.append(r["text"] or "")
        found.append(r["y"])
    return texts, np.array(found, np.int64)


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Model:
    texts, y = sample(docs, labels, per_class)
    if len(set(y.tolist())) < 2:
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-9, 1 - 1e-9))
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    return fit(texts, y)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # BUCKETS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for b in batches:
            s = np.array([scorer(t) for t in texts_of(b.column(2))], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
