"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a fixed pseudo-random order, are cut into blocks of ``block`` documents.
With integer weights p of total Q, block j (from 0) of a source may run from slot floor(j Q / p) on
and must run before slot ceil((j + 1) Q / p). One block runs in each slot: the released one with the
earliest deadline, ties to the smaller source. As the weights fill the slots exactly, every deadline
is met, so that after any number of slots a source is less than one block from its share. The
schedule repeats after Q slots, hence one period, of bounded length, describes all blocks.

When a source runs out, a new phase begins: the weights of the others are taken against their own
sum, and the bound holds anew from there. No document is dropped or repeated.

Ranks inside a source come from shards, so that a source with a third of all rows is nobody's single
task, and the plan is joined as one small row for each (source, phase).

Weights are taken exactly: decimals as written, ratios as fractions. A period has as many slots as the
weights' least common denominator; at most ``MOST_SLOTS`` of them are simulated on the driver (fewer,
if a phase ends before), and finer weights are refused rather than rounded.

Defined results. A null source is a source of its own, with the default weight. Sources missing from
the weights keep their default share, and the listed ones divide the rest in their proportions; listed
sources without documents are ignored. Sources of weight 0 come after all others. Repeated rows are
separate documents, in any order among themselves, as are those of null doc_id. Texts, of any length,
are not read. Extra columns pass through, but for one named like a result; an empty table gives an empty one.
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_left
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, distributed_rank, hash_shard, key_of, own, shard_bits

BLOCK = 32
#: The default target is in parts of about this sum.
RESOLUTION = 1_000
#: Slots of one phase that may be simulated: eight bytes each on the driver.
MOST_SLOTS = 5_000_000
#: Default target: a source's share of documents to this power, so that small sources are lifted.
TEMPERATURE = 0.5


def period(units: Mapping[str, int], until: int | None = None) -> dict[str, array]:
    """Slots of each source's blocks within one period of sum(units) slots, or the first ``until`` of it, by earliest deadline first."""
    q = sum(units.values())
    slots = {s: array("q") for s in units}
    coming = [(0, s) for s in units]
    heapq.heapify(coming)
    ready: list[tuple[int, str]] = []
    for t in range(q if until is None else min(q, until)):
        while coming and coming[0][0] <= t:
            s = heapq.heappop(coming)[1]
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * q // units[s]), s))
        s = heapq.heappop(ready)[1]
        slots[s].append(t)
        if len(slots[s]) < units[s]:
            heapq.heappush(coming, (len(slots[s]) * q // units[s], s))
    return slots


def reduced(weights: Mapping[str, Fraction]) -> dict[str, int]:
    """The least integers in exactly these proportions."""
    common = math.lcm(*[w.denominator for w in weights.values()]) if weights else 1
    whole = {s: int(w * common) for s, w in weights.items()}
    by = math.gcd(*whole.values()) or 1
    return {s: n // by for s, n in whole.items()}


def plan(blocks: Mapping[str, int], weights: Mapping[str, int | Fraction]) -> list[tuple]:
    """(source, phase, first block, end block, first slot, period, units, slots) for every source and phase."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    out, start, phase = [], 0, 0
    while left:
        some = [s for s in sorted(left) if weights[s] > 0]
        active = reduced({s: Fraction(weights[s]) for s in some} if some else dict.fromkeys(sorted(left), Fraction(1)))
        q = sum(active.values())
        # The first source to run out does so before the deadline of its last block.
        bound = min(-(-left[s] * q // p) for s, p in active.items())
        if min(q, bound) > MOST_SLOTS or q >= 1 << 60:
            raise ValueError(f"weights with a period of {q} slots: give them with fewer digits, so that at most {MOST_SLOTS} are simulated")
        slots = period(active, bound)
        ends = {}
        for s, p in active.items():
            rounds, last = divmod(left[s] - 1, p)
            if last < len(slots[s]):
                ends[s] = rounds * q + slots[s][last] + 1
        length = min(ends.values())
        for s, p in active.items():
            n = length // q * p + bisect_left(slots[s], length % q)
            if n:
                out.append((s, phase, done[s], done[s] + n, start, q, p, slots[s][: min(p, n)].tolist()))
            done[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        start += length
        phase += 1
    return out


def default_units(counts: Mapping[str, int], resolution: int = RESOLUTION) -> dict[str, int]:
    """The default target: shares to the power ``TEMPERATURE``, in whole parts, at least one each."""
    total = sum(counts.values()) or 1
    raw = {s: (n / total) ** TEMPERATURE for s, n in counts.items()}
    whole = sum(raw.values()) or 1
    return {s: max(1, round(resolution * w / whole)) for s, w in raw.items()}


def targets(counts: Mapping[str, int], weights: Mapping[str, float | int | Fraction] | None = None, resolution: int = RESOLUTION) -> dict[str, Fraction]:
    """The exact target of every source key in ``counts``; see above for sources that ``weights`` does not list."""
    units = {s: Fraction(u) for s, u in default_units(counts, resolution).items()}
    given = {s: Fraction(str(weights[s[1:]])) for s in counts if weights and s[1:] in weights and s != "null"}
    if any(w < 0 for w in given.values()):
        raise ValueError("a weight is negative")
    listed = sum(given.values(), Fraction(0))
    if not listed:
        return {s: given.get(s, u) for s, u in units.items()}
    share = sum((units[s] for s in given), Fraction(0)) / listed
    return {s: given[s] * share if s in given else u for s, u in units.items()}


_NAMES = ["block", "block_pos", "phase", "release", "deadline", "slot"]


def _placed(docs: DataFrame, weights: Mapping[str, float | int | Fraction] | None = None, block: int = BLOCK, resolution: int = RESOLUTION) -> DataFrame:
    """(row, block, block_pos, phase, release, deadline, slot), where ``row`` holds the columns of ``docs``."""
    spark = docs.sparkSession
    boxed = docs.select(F.struct(*own(docs)).alias("row"))
    keyed = boxed.withColumn("_source", key_of(F.col("row")["source"]))
    counts = {r["_source"]: r["count"] for r in keyed.groupBy("_source").count().collect()}
    shard, order = hash_shard(F.col("row")["doc_id"], shard_bits(sum(counts.values())))
    ranked = distributed_rank(keyed.withColumns({"_shard": shard, "_order": order}), ["_source"], ["_shard"], ["_order", "row.doc_id"], "_rank")
    ranked = ranked.withColumns({"block": F.floor(F.col("_rank") / block).cast("long"), "block_pos": (F.col("_rank") % block).cast("int")})
    rows = plan({s: -(-n // block) for s, n in counts.items()}, targets(counts, weights, resolution))
    schema = "_source string, phase int, _from long, _to long, _start long, _q long, _p long, _slots array<long>"
    steps = spark.createDataFrame(rows, schema)
    # Its size is known: at most sources x phases rows, with as many slots in all as the periods are long.
    if sum(len(r[-1]) + 8 for r in rows) <= 4_000_000:
        steps = F.broadcast(steps)
    placed = ranked.join(steps, "_source").where((F.col("block") >= F.col("_from")) & (F.col("block") < F.col("_to")))
    # In decimals, as block x period may exceed a long: windows are exact at any size.
    placed = placed.withColumns({"_round": F.expr("_start + (block - _from) div _p * _q"), "_at": F.expr("(block - _from) % _p"), "_wide": F.col("_q").cast("decimal(18,0)")})
    placed = placed.withColumns(
        {
            "release": F.expr("_round + cast(_at as decimal(18,0)) * _wide div _p"),
            "deadline": F.expr("_round + (cast(_at + 1 as decimal(18,0)) * _wide + _p - 1) div _p"),
            "slot": F.col("_round") + F.get("_slots", F.col("_at").cast("int")),
        }
    )
    return placed.select("row", *_NAMES)


def mix(docs: DataFrame, weights: Mapping[str, float | int | Fraction] | None = None, block: int = BLOCK, resolution: int = RESOLUTION) -> DataFrame:
    """``docs`` with block, block_pos, phase, release, deadline and slot; (slot, block_pos) is the mixed order.

    Work on the driver grows with sources x the period, not with documents: one count a source comes in.
    """
    placed = _placed(docs, weights, block, resolution)
    return placed.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in _NAMES], *_NAMES)


def in_mixed_order(docs: DataFrame, **options) -> DataFrame:
    """The documents' own columns, dealt into files in mixed order: file by file, row by row."""
    placed = _placed(docs, **options).select("row", "slot", "block_pos")
    return placed.repartitionByRange("slot", "block_pos").sortWithinPartitions("slot", "block_pos").select("row.*")


def mixed_positions(docs: DataFrame, **options) -> DataFrame:
    """Only the plan of every document: doc_id, source and where it stands."""
    return mix(cut(docs.select("doc_id", "source")), **options)
