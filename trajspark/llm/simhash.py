"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. Two fingerprints that differ in at most three
bits have a segment that differs in at most one, so each fingerprint is indexed, for each segment,
under the segment itself and under its 32 variants with one bit deleted. An equality join on the
variants, where a deleted bit must differ, meets every such pair once a segment; it is verified by
the Hamming distance. Segments shared by more than ``HOT`` distinct fingerprints are keyed further
by the same variants of the other segment's halves, so that no bucket holds a large group.

Fingerprints are distinct before they are joined: copies never meet in pairs, and a group of any
size costs one row. Links become components by alternating large-star and small-star steps. Tables of a
row for each fingerprint, component or document are merged, never broadcast, so that the driver holds none of them.

Defined results. Null and empty texts, and texts without a word, have fingerprint zero and link like
any other. A null doc_id takes part; it sorts before all others and shows as a null component_id.
Repeated rows appear as often as they occur. An empty table gives an empty result. Other columns
of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import cut, own, shard_bits, texts, unused

SHINGLE = 3
SEED = 42
MOST_BITS = 3
SEGMENT_BITS = 32
#: Distinct fingerprints that may share a segment before its buckets are split further.
HOT = 512
#: Distinct fingerprints in a partition before they are exploded.
_DEALT = 5_000
_NO_ID = -(2**63)
#: Shingles hashed at a time, so that a very long text needs no more memory than this many.
_STEP = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """Unsigned 64-bit SimHash of a whole text (UTF-8)."""
    import xxhash

    words = (text or b"").lower().split()  # bytes: only A-Z change, only the six ASCII blanks split
    if not words:
        return 0
    k = min(SHINGLE, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - k + 1
    ones = np.zeros(64, np.int64)
    hash_of = xxhash.xxh64_intdigest
    for a in range(0, n, _STEP):
        b = min(n, a + _STEP)
        pairs = zip(starts[a:b].tolist(), ends[a + k - 1 : b + k - 1].tolist(), strict=True)
        h = np.fromiter((hash_of(joined[i:j], SEED) for i, j in pairs), np.uint64, b - a)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, fp) of every row: a hash of the text, and the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.array([fingerprint(t) for t in texts(batch.column(2))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(f)], ["doc_id", "hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("hash"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, hash long, fp long")


def _variants(value: Column, bits: int) -> Column:
    """(pos, key, bit) of a value of ``bits`` bits: itself at pos -1, then one bit deleted at each place."""
    one = F.lit(1).cast("long")
    whole = F.array(F.struct(F.lit(-1).alias("pos"), value.alias("key"), F.lit(-1).alias("bit")))
    holes = [
        F.struct(F.lit(i).alias("pos"), value.bitwiseAND(F.lit((1 << bits) - 1 - (1 << i))).alias("key"), F.shiftright(value, i).bitwiseAND(one).cast("int").alias("bit"))
        for i in range(bits)
    ]
    return F.concat(whole, F.array(*holes))


def _segments(fp: Column) -> list[Column]:
    mask = F.lit((1 << SEGMENT_BITS) - 1)
    return [fp.bitwiseAND(mask), F.shiftrightunsigned(fp, SEGMENT_BITS)]


def _meet(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Verified pairs (u > v) of rows that share ``keys`` and differ at the deleted bits, if any."""
    a, b = rows.alias("a"), rows.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    bits = [c for c in rows.columns if c.startswith("bit")]
    lead = bits[0]
    ordered = F.when(F.col(f"a.{lead}") >= 0, F.col(f"a.{lead}") < F.col(f"b.{lead}")).otherwise(F.col("a.fp") < F.col("b.fp"))
    met = a.join(b.hint("merge"), on).where(ordered)
    for c in bits[1:]:
        met = met.where((F.col(f"a.{c}") != F.col(f"b.{c}")) | (F.col(f"a.{c}") < 0))
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MOST_BITS
    u, v = F.greatest("a.fp", "b.fp"), F.least("a.fp", "b.fp")
    return met.where(near).select(u.alias("u"), v.alias("v"))


def links(distinct: DataFrame) -> DataFrame:
    """All pairs (u > v) of distinct fingerprints that differ in 1 to 3 bits. ``distinct`` has column fp."""
    segments = F.array(*[F.struct(F.lit(i).alias("seg"), s.alias("own")) for i, s in enumerate(_segments(F.col("fp")))])
    split = distinct.select("fp", F.inline(segments))
    hot = cut(split.groupBy("seg", "own").count().where(F.col("count") > HOT).select("seg", "own"))
    rows = split.select("fp", "seg", F.inline(_variants(F.col("own"), SEGMENT_BITS)))
    keys = ["seg", "pos", "key"]
    if hot.isEmpty():
        return _meet(rows, keys).distinct()
    wide = hot.select("seg", F.inline(_variants(F.col("own"), SEGMENT_BITS))).select(*keys).distinct().withColumn("_hot", F.lit(True))
    marked = rows.join(wide, keys, "left")
    calm = _meet(marked.where("_hot is null").drop("_hot"), keys)
    # Bits left for the other segment are at most three, so that one of its halves differs in at most one.
    low, high = _segments(F.col("fp"))
    other = F.when(F.col("seg") == 0, high).otherwise(low)
    half = SEGMENT_BITS // 2
    halves = F.array(F.struct(F.lit(0).alias("half"), other.bitwiseAND(F.lit((1 << half) - 1)).alias("part")), F.struct(F.lit(1).alias("half"), F.shiftright(other, half).alias("part")))
    fine = marked.where("_hot").select("fp", *keys, "bit", F.inline(halves))
    fine = fine.select("fp", *keys, "bit", "half", F.inline(_variants(F.col("part"), half)).alias("pos2", "key2", "bit2"))
    return calm.unionByName(_meet(fine, [*keys, "half", "pos2", "key2"])).distinct()


def _owners(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint; a null doc_id counts as ``_NO_ID``.

    The root, a fingerprint, tells components apart also where one doc_id is in several.
    """
    nodes = prints.groupBy("fp").agg(F.min(F.coalesce(F.col("doc_id"), F.lit(_NO_ID))).alias("least"))
    # Links explode each fingerprint 66-fold: dealt out by their number, not by their bytes, which adaptive execution would put in a few tasks.
    nodes = cut(nodes)
    dealt = nodes.select("fp").repartition(1 << shard_bits(nodes.count(), _DEALT, 3), "fp")
    roots = components(links(dealt)).withColumnsRenamed({"node": "fp"})
    rooted = nodes.join(roots.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select("fp", "root").join(ids.hint("merge"), "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    prints = cut(fingerprints(docs))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(_owners(prints).hint("merge"), "fp").select("doc_id", hexed.alias("fingerprint"), F.when(F.col("component_id") != _NO_ID, F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component, with its own columns: that of smallest doc_id (null first), then of smallest text hash.

    Of rows equal in both, which differ in their other columns at most, any one.
    """
    prints = cut(fingerprints(docs))
    keyed = prints.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "hash", "fp").groupBy("id", "hash", "fp").agg(F.count(F.lit(1)).alias("n"))
    first = keyed.join(_owners(prints).hint("merge"), "fp").groupBy("root").agg(F.min(F.struct("id", "hash", "n")).alias("f"))
    key, text, times = (unused(docs.columns, c) for c in ("id", "hash", "n"))
    first = cut(first.select(F.col("f.id").alias(key), F.col("f.hash").alias(text), F.col("f.n").alias(times)))
    rows = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), text: F.xxhash64("text")})
    kept = rows.join(first.where(F.col(times) == 1).hint("merge"), [key, text], "left_semi").select(*own(docs))
    again = first.where(F.col(times) > 1)
    if again.isEmpty():
        return kept
    # Repeats are folded by an aggregate, before the shuffle and after it: no task sorts or holds a group.
    once = rows.join(again, [key, text], "left_semi").groupBy(key, text).agg(F.any_value(F.struct(*own(docs))).alias("row"))
    return kept.unionByName(once.select("row.*"))
