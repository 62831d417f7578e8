"""Packing documents into token batches through optimal length buckets.

Documents are split into pieces of at most ``seq_len`` tokens, so that the histogram of piece
lengths, gathered over all documents, has at most ``seq_len`` + 1 rows whatever the corpus holds.
Dynamic programming over it chooses the ``buckets`` boundaries that minimise padding exactly; the
minimum over earlier boundaries is a lower envelope of lines, so that it takes buckets x lengths
steps. Inside a bucket, pieces are numbered in input order and every budget // boundary of them
form a batch.

Input order is that of files and their rows where the documents come straight from files, else that
of a hash of doc_id. Numbers inside a bucket are counted through shards, never in one task.

Defined results. A null or empty text, or one without a word, is one piece of length 0 in the first
bucket. Repeated rows are packed as often as they occur. A boundary above the budget gives batches
of one piece. A very long text becomes as many pieces as it needs. Away from files, rows of equal hash and
doc_id, a null one too, may come in any order among themselves. Extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, distributed_rank, hash_shard, shard_bits

SEQ_LEN = 2_048
BUCKETS = 16
BUDGET = 65_536


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper boundaries of at most ``buckets`` buckets with the least padding; ``lengths`` ascend.

    cost[k][j] = min over i of cost[k-1][i] + L_j (C_j - C_i), less the tokens themselves. For each k
    the candidates are lines in L_j with falling slopes -C_i, so their lower envelope is a stack that
    the rising L_j walk once.
    """
    m = len(lengths)
    if m == 0:
        return []
    upto = np.concatenate(([0], np.cumsum(counts))).tolist()
    prev: list[float] = [0] + [float("inf")] * m
    back: list[list[int]] = []
    for _ in range(min(buckets, m)):
        cost, own = [float("inf")] * (m + 1), [0] * (m + 1)
        cost[0] = 0
        hull: list[int] = []
        at = 0

        def over(a: int, b: int, c: int) -> bool:
            """Whether line b lies above the lower envelope of a and c."""
            return (prev[c] - prev[a]) * (upto[b] - upto[a]) <= (prev[b] - prev[a]) * (upto[c] - upto[a])

        for j in range(1, m + 1):
            if prev[j - 1] < float("inf"):
                while len(hull) >= 2 and over(hull[-2], hull[-1], j - 1):
                    hull.pop()
                hull.append(j - 1)
            at = min(at, len(hull) - 1)
            x = lengths[j - 1]
            while at + 1 < len(hull) and prev[hull[at + 1]] - x * upto[hull[at + 1]] <= prev[hull[at]] - x * upto[hull[at]]:
                at += 1
            i = hull[at]
            cost[j], own[j] = prev[i] + x * (upto[j] - upto[i]), i
        prev = cost
        back.append(own)
    found, j = [], m
    for own in reversed(back):
        if j == 0:
            break
        found.append(lengths[j - 1])
        j = own[j]
    return found[::-1]


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def _in_order(docs: DataFrame, length: Column) -> tuple[DataFrame, list[str], list[str]]:
    """(doc_id, n) with shard and order columns of the input order."""
    try:
        at = docs.select("doc_id", length.alias("n"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        return at.withColumn("_part", F.floor(F.col("_row") / 8_192)), ["_file", "_part"], ["_row"]
    except AnalysisException:
        bits = shard_bits(docs.count())
        shard, order = hash_shard(F.col("doc_id"), bits)
        return docs.select("doc_id", length.alias("n"), shard.alias("_part"), order.alias("_row")), ["_part"], ["_row", "doc_id"]


def pack(docs: DataFrame, seq_len: int = SEQ_LEN, buckets: int = BUCKETS, budget: int = BUDGET, length: Column | None = None) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bucket, batch, batch_pos): every piece and the batch that holds it.

    ``start`` counts tokens from the document's first; ``length`` gives a document's tokens, by default its words.
    """
    spark = docs.sparkSession
    found, shards, order = _in_order(docs, words_of(F.col("text")) if length is None else length)
    found = cut(found)
    n = F.greatest(F.ceil(F.col("n") / seq_len), F.lit(1)).cast("long")
    pieces = found.select("*", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("piece"))
    pieces = pieces.withColumns({"start": F.col("piece") * seq_len, "n_tokens": F.least(F.col("n") - F.col("piece") * seq_len, F.lit(seq_len)).cast("long")})
    histogram = sorted((r["n_tokens"], r["count"]) for r in pieces.groupBy("n_tokens").count().collect())
    tops = boundaries([a for a, _ in histogram], [b for _, b in histogram], buckets) or [0]
    bucket = F.lit(tops[-1])
    for top in reversed(tops[:-1]):
        bucket = F.when(F.col("n_tokens") <= top, F.lit(top)).otherwise(bucket)
    placed = distributed_rank(pieces.withColumn("bucket", bucket.cast("long")), ["bucket"], shards, [*order, "piece"], "_rank")
    size = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("bucket"), F.lit(1))), F.lit(1)).cast("long")
    placed = placed.withColumns({"batch": F.floor(F.col("_rank") / size).cast("long"), "batch_pos": (F.col("_rank") % size).cast("int")})
    return placed.select("doc_id", "piece", "start", "n_tokens", "bucket", "batch", "batch_pos")
