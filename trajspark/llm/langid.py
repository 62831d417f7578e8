"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased; each maximal run of letters, between blanks, gives its n-grams of 1 to 3
characters, hashed into ``BUCKETS``. Document frequencies are counted over every document of the
learning fold; the regression is fitted on a bounded sample by follow-the-regularised-leader with
L1 and L2 penalties (the L1 part keeps it sparse), and its logits are divided by a temperature that
minimises the log loss of a part of the sample set aside. Every language of the learning fold is
learned: the sample takes at least ``LEAST_TEXTS`` of each, however long they are. The model is
held and sent as its non-zero weights; the fit's state grows with the number of languages.

Defined results. A very long text is read whole, a stretch at a time. Null texts and texts without a letter are 'und' with score 0. Null languages are
never learned. With one language to learn, it is predicted with score 1; with none, 'und' with score 0.
Ties go to the language that sorts first. Repeated rows are predicted alike; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts
from .toxicity import held_out

BUCKETS = 1 << 14
#: Documents of each language that the fit may use, and characters of all of them; bounds the driver's work.
SAMPLE = 800
SAMPLE_CHARS = 12_000_000
LEAST_TEXTS = 3
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-3, 1e-3
UND = "und"
#: Code points hashed at a time, so that a very long text needs no more memory than this many.
_STEP = 1 << 18


def _letters(codes: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter: ASCII by range, the others by Python's tables, once for each distinct one."""
    out = (codes >= 97) & (codes <= 122) | (codes >= 65) & (codes <= 90)
    wide = codes >= 128
    if wide.any():
        u, inv = np.unique(codes[wide], return_inverse=True)
        out[wide] = np.array([chr(c).isalpha() for c in u.tolist()])[inv]
    return out


def counts(text: str | None) -> np.ndarray | None:
    """How often each bucket occurs in the whole text, or None for a text without a letter.

    Stretches overlap by two code points, and an n-gram counts where its last code point is new, so
    that words and n-grams over the edge of a stretch count once, and as in one piece.
    """
    total, some = np.zeros(BUCKETS, np.int64), False
    text = text or ""
    before = np.array([32, 32], np.uint64)
    for a in range(0, len(text), _STEP):
        c = np.frombuffer(text[a : a + _STEP].lower().encode("utf-32-le", "replace"), np.uint32)
        is_letter = _letters(c)
        some = some or bool(is_letter.any())
        c = np.where(is_letter, c, 32).astype(np.uint64)
        if a + _STEP >= len(text):
            c = np.append(c, np.uint64(32))
        c = np.concatenate((before, c))
        before = c[-2:]
        first = c * np.uint64(2_654_435_761)
        one = first[2:][c[2:] != 32]
        two = (first[1:-1] ^ (c[2:] * np.uint64(40_503_001)))[(c[1:-1] != 32) | (c[2:] != 32)]
        three = (first[:-2] ^ (c[1:-1] * np.uint64(40_503_001)) ^ (c[2:] * np.uint64(97_531_357)))[c[1:-1] != 32]
        for k, h in enumerate((one, two, three)):
            h = (h + np.uint64(k * 7_919)) * np.uint64(0x9E3779B97F4A7C15)
            total += np.bincount((h >> np.uint64(50)).astype(np.int64), minlength=BUCKETS)
    return total if some else None


def vector(n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their TF-IDF (logarithmic counts), of length 1."""
    at = np.flatnonzero(n)
    v = (1 + np.log(n[at])) * idf[at]
    return at, v / (np.sqrt((v * v).sum()) or 1)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    shape: tuple = field(default=(BUCKETS,))

    def __getstate__(self) -> dict:
        """Sent as rows of non-zero weights."""
        at = np.flatnonzero(self.weights)
        return {**self.__dict__, "weights": (self.weights.shape, at, self.weights.ravel()[at])}

    def __setstate__(self, state: dict) -> None:
        shape, at, values = state["weights"]
        w = np.zeros(shape)
        w.ravel()[at] = values
        self.__dict__.update(state, weights=w)

    def logits(self, n: np.ndarray) -> np.ndarray:
        at, v = vector(n, self.idf)
        return v @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        n = counts(text) if self.languages else None
        if n is None:
            return UND, 0.0
        p = softmax(self.logits(n) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, epochs: int = EPOCHS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by follow-the-regularised-leader, proximal form, per coordinate and class."""
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))
    rng = np.random.default_rng(seed)

    def weights(at: np.ndarray) -> np.ndarray:
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(nn)) / ALPHA + L2))

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, v = np.append(rows[i][0], BUCKETS), np.append(rows[i][1], 0.1)
            w = weights(at)
            p = softmax(v @ w)
            p[y[i]] -= 1
            g = v[:, None] * p[None, :]
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - s * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:-1], w[-1] * 0.1


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""
    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()

    a, b, g = -4.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Over all documents of the learning fold: in how many each bucket occurs, and how many have letters. One array a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS + 1, np.int64), 0
        for b in batches:
            for t in texts(b.column(0)):
                c = counts(t)
                if c is not None:
                    df[:-1] += c > 0
                    n += 1
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["bucket", "n"])

    learn = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("text")
    rows = learn.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most BUCKETS + 1
    df = np.zeros(BUCKETS + 1, np.int64)
    for r in rows:
        df[r["bucket"]] = r["n"]
    return df[:-1], int(df[-1])


def sample(docs: DataFrame, per_language: int = SAMPLE, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[str]]:
    """Whole texts and languages: of each language about ``per_language`` documents of smallest hash, while its share
    of ``chars`` lasts, but the first ``LEAST_TEXTS`` in any case."""
    learn = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    sizes = [(r["lang"], min(1.0, per_language / r["count"])) for r in learn.groupBy("lang").count().collect()]  # one row a language
    if not sizes:
        return [], []
    share = chars // len(sizes)
    upto = docs.sparkSession.createDataFrame(sizes, "lang string, upto double")
    # Texts of null or repeated ids are told apart by their length.
    u = F.shiftrightunsigned(F.xxhash64("doc_id", F.octet_length("text")), 11) / float(1 << 53)
    picked = learn.select("doc_id", "lang", "text").join(F.broadcast(upto), "lang").where(u <= F.col("upto")).drop("upto")
    # The exchange lets the whole scan run in parallel, and holds the sample alone; its order is the same in every run.
    picked = picked.repartition(16, "lang", "doc_id").sortWithinPartitions(F.octet_length("text"), "doc_id", "lang", "text")
    got, langs, used, n = [], [], {}, {}
    for r in picked.toLocalIterator():
        size, lang = len(r["text"] or ""), r["lang"]
        if n.get(lang, 0) < LEAST_TEXTS or used.get(lang, 0) + size <= share:
            n[lang] = n.get(lang, 0) + 1
            used[lang] = used.get(lang, 0) + size
            got.append(r["text"] or "")
            langs.append(lang)
    return got, langs


def train(docs: DataFrame, per_language: int = SAMPLE) -> Model:
    df, n = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + df)) + 1
    chosen, langs = sample(docs, per_language)
    names = sorted(set(langs))
    rows, y = [], []
    for t, lang in zip(chosen, langs, strict=True):
        c = counts(t)
        if c is not None:
            rows.append(vector(c, idf))
            y.append(names.index(lang))
    if not rows:
        return Model([], idf, np.zeros((BUCKETS, 0)), np.zeros(0))
    y = np.array(y)
    if len(names) == 1:
        return Model(names, idf, np.zeros((BUCKETS, 1)), np.zeros(1))
    aside = np.arange(len(rows)) % 5 == 4
    w, bias = ftrl([r for r, x in zip(rows, aside, strict=True) if not x], y[~aside], len(names))
    t = 1.0
    if aside.any():
        logits = np.array([v @ w[at] + bias for (at, v), x in zip(rows, aside, strict=True) if x])
        t = calibrate(logits, y[aside])
    return Model(names, idf, w, bias, t)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the non-zero ones of BUCKETS x languages weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.predict(t) for t in texts(b.column(2))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"]
            )

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
