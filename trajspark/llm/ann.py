"""Approximate nearest neighbours by cosine, over randomly rotated one-bit codes.

A unit vector is padded to ``CODE_BITS`` (or more) dimensions, rotated by a fixed random orthogonal
matrix, and stored as its signs, packed, with one correction scalar c: the inner product of the
vector with its code. A query q, rotated likewise, has the estimate <code, q> / c of its cosine,
whose error is below ``ERROR_FACTOR`` sqrt((1 - c^2) / c^2 / (D - 1)) with high probability. A vector
whose upper bound is below the k-th largest lower bound, or the k-th best score found so far, cannot be
among the k nearest; all others are ranked again by the exact cosine of the original vectors in double
precision, where these are: index and vectors never leave their partition.

Queries go out in blocks of at most ``QUERY_BYTES``, each broadcast to one pass over the index; what comes
back through a shuffle are the k best of each partition. Every vector is indexed and compared with every
query: no lists are probed or skipped, and the only approximation is the probability that a bound fails.
Codes are kept and read packed. A task unpacks a few thousand of them at a time for all queries of a
block, as NumPy multiplies signs by BLAS several times as fast as it counts bits of words.

Defined results. Vectors that are null, empty or zero, or hold null or non-finite components, take
no part, neither do rows with a null vec_id. Components are widened to doubles; other columns are ignored. Vectors are compared with those of their own length.
Ties go to the smaller vec_id. With fewer than k candidates all are returned; an empty table gives
an empty result. Repeated vec_ids are separate candidates, but never their own query's;
a repeated query is asked once, and one of the same vec_id but another vector is a query of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

TOP = 5
EVERY = 50
CODE_BITS = 256
ERROR_FACTOR = 2.2
SEED = 20_240_229
#: Single precision of the estimates.
_SLACK = 1e-5
#: Bytes of one block of queries: what the driver holds and a pass broadcasts.
QUERY_BYTES = 32 << 20
#: Rows of the index in a partition, at least eight partitions.
PART_ROWS = 65_536
#: Vectors and queries estimated at a time, and pairs ranked at a time: a task's working set.
_ROWS, _STEP, _PAIRS = 8_192, 128, 65_536


def rotation(bits: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return q * np.sign(np.diag(r))


def code_bits(dim: int, bits: int = CODE_BITS) -> int:
    """Bits of a code: at least those of the vector, in whole bytes."""
    return -(-max(bits, dim) // 8) * 8


def encode(unit: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs and correction scalars of unit vectors (rows)."""
    turned = unit @ rot[: unit.shape[1]]
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / np.sqrt(rot.shape[0])


def unpack(codes: np.ndarray) -> np.ndarray:
    """Packed codes as signs, -1 and 1."""
    return np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1


def estimate(turned: np.ndarray, signs: np.ndarray, c: np.ndarray, factor: float = ERROR_FACTOR) -> tuple[np.ndarray, np.ndarray]:
    """(cosine estimates of queries x vectors, error bound of each vector)."""
    d = signs.shape[1]
    est = (turned.astype(np.float32) @ signs.T) / np.sqrt(d) / c.astype(np.float32)
    return est, (factor * np.sqrt(np.maximum(0, 1 - c * c) / (c * c) / (d - 1))).astype(np.float32)


def _best(best: tuple[np.ndarray, np.ndarray, np.ndarray], top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``top`` best of (query, vec_id, score) triples, for each query."""
    order = np.lexsort((best[1], -best[2], best[0]))
    q, i, s = (x[order] for x in best)
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    keep = place < top
    return q[keep], i[keep], s[keep]


class _Queries:
    """Queries of one length, and the best found for them so far."""

    def __init__(self, rows: list, dim: int, top: int, factor: float):
        self.rot = rotation(code_bits(dim))
        self.q = np.frombuffer(b"".join(bytes(r["vector"]) for r in rows), np.float64).reshape(-1, dim)
        self.id, self.of = np.array([r["vec_id"] for r in rows]), np.array([r["of"] for r in rows])
        self.norm = np.sqrt((self.q * self.q).sum(1))
        self.turned = (self.q / self.norm[:, None]) @ self.rot[:dim]
        self.top, self.factor = top, factor
        none = np.zeros(0, np.int64)
        self.best = (none, none, np.zeros(0))
        self.least = np.full(len(rows), -np.inf)

    def meet(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, c: np.ndarray) -> None:
        norm, signs = np.sqrt((x * x).sum(1)), unpack(codes)
        found = [self.best]
        for a in range(0, len(self.q), _STEP):
            est, err = estimate(self.turned[a : a + _STEP], signs, c, self.factor)
            own = self.id[a : a + _STEP, None] == ids[None, :]
            k = min(self.top, len(ids))
            lower = np.where(own, -np.inf, est - err)
            least = np.maximum(-np.partition(-lower, k - 1, axis=1)[:, k - 1], self.least[a : a + _STEP]) - _SLACK
            if k < self.top:
                least = np.minimum(least, self.least[a : a + _STEP] - _SLACK)
            near, at = np.nonzero((est + err >= least[:, None]) & ~own)
            for b in range(0, len(at), _PAIRS):
                i, j = near[b : b + _PAIRS] + a, at[b : b + _PAIRS]
                found.append(_best((i, ids[j], (x[j] * self.q[i]).sum(1) / (norm[j] * self.norm[i])), self.top))
        self.best = _best(tuple(np.concatenate(z) for z in zip(*found, strict=True)), self.top)
        count = np.bincount(self.best[0], minlength=len(self.q))
        worst = np.full(len(self.q), np.inf)
        np.minimum.at(worst, self.best[0], self.best[2])
        self.least = np.where(count == self.top, worst, -np.inf)


def _search(blocks: dict[int, list], top: int, factor: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = {dim: _Queries(rows, dim, top, factor) for dim, rows in blocks.items()}
        for b in batches:
            for dim, part in b.groupby("dim"):
                if int(dim) not in asked:
                    continue
                for a in range(0, len(part), _ROWS):
                    p = part.iloc[a : a + _ROWS]
                    x = np.frombuffer(b"".join(p["vector"]), np.float64).reshape(len(p), int(dim))
                    codes = np.frombuffer(b"".join(p["code"]), np.uint8).reshape(len(p), -1)
                    asked[int(dim)].meet(p["vec_id"].to_numpy(), x, codes, p["c"].to_numpy())
        for q in asked.values():
            i, ids, score = q.best
            yield pd.DataFrame({"query_id": q.id[i], "of": q.of[i], "vec_id": ids, "score": score})

    return run


def _index(batches):
    for b in batches:
        for dim, part in b.groupby("dim"):
            rot = rotation(code_bits(int(dim)))
            x = np.array(part["v"].tolist(), np.float64).reshape(len(part), int(dim))
            x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])  # by powers of two, so that no square over- or underflows
            codes, c = encode(x / np.sqrt((x * x).sum(1))[:, None], rot)
            yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy(), "dim": int(dim), "vector": [r.tobytes() for r in x], "code": [r.tobytes() for r in codes], "c": c})


def index(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, vector, code, c) of every usable vector, scaled by a power of two."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where((F.size("v") > 0) & finite)
    v = v.where(F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))
    return v.mapInPandas(_index, "vec_id long, dim int, vector binary, code binary, c double")


def nearest(vectors: DataFrame, every: int = EVERY, top: int = TOP, factor: float = ERROR_FACTOR, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``top`` nearest of each query: the rows whose vec_id ``every`` divides."""
    coded = cut(index(vectors.select("vec_id", "embedding").repartition(max(8, -(-vectors.count() // PART_ROWS)))))
    queries = coded.where(F.pmod("vec_id", F.lit(every)) == 0).select("dim", "vec_id", "vector").distinct()
    queries = cut(queries.withColumn("of", F.xxhash64("dim", "vector")))
    size = queries.agg(F.sum(F.octet_length("vector") + 3 * 8 * CODE_BITS)).first()[0] or 0  # with its turned form
    blocks = max(1, -(-size // query_bytes))
    schema = "query_id long, of long, vec_id long, score double"
    best = Window.partitionBy("query_id", "of").orderBy(F.col("score").desc(), "vec_id")
    passes = []
    for b in range(blocks):
        asked: dict[int, list] = {}
        for r in queries.where(F.pmod(F.xxhash64("vec_id", "of"), F.lit(blocks)) == b).collect():  # about query_bytes
            asked.setdefault(r["dim"], []).append(r)
        found = coded.mapInPandas(_search(asked, top, factor), schema) if asked else coded.sparkSession.createDataFrame([], schema)
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
        passes.append(cut(found) if blocks > 1 else found)
    return reduce(DataFrame.unionByName, passes)
