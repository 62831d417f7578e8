"""Removal of multi-line passages that repeat anywhere in the corpus, by content-defined line chunks.

A line ends a chunk where a rolling hash over its own hash and those of the ``WINDOW - 1`` lines
before it is 0 modulo ``MEAN_LINES``. Boundaries depend on nearby lines only, so a passage pasted
at any offset is cut alike, but for its edges. Chunks of two or more lines that hold a word are
compared by their bytes: groups are keyed by (hash, text), and a document drops a chunk only after
comparing it with the stored text. The first occurrence stays: smallest doc_id, then first in it.

DataFrame expressions only. Texts are shuffled twice (counting, and joining what goes to its
documents); a very common chunk is pre-aggregated before the shuffle, and the join on it has one
row for each chunk on the other side, so that adaptive execution can split it.

``passages`` makes the edges exact. Boundaries then also depend on how often each pair of neighbouring lines
occurs in the corpus: a chunk ends where a pair is rarer than the pair beside it, so that a passage pasted
between private lines is a chunk of just its own lines, and not within pairs that repeat. Lines of
``LEAST_WORDS`` words that repeat are chunks of their own, and a chunk of so many words goes even if it is
one line. Pairs are counted by two hashes, before the shuffle and after it; what goes is still compared by its text.

Removed chunks are found by their place in the document, so that work grows with the text, not with its square.

Defined results. Null text stays null, with zero counts; an empty text is one empty line. Rows that
share a doc_id are one document. A null doc_id sorts before all others. A document whose every chunk
goes becomes ''. Other columns pass through unchanged, but for one named like a count; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, WORD, cut, own

WINDOW = 2
BASE = 31
PRIME = 1_000_003
MEAN_LINES = 4
LEAST_LINES = 2
#: With ``passages``: words of a chunk, or of a line, that may go alone.
LEAST_WORDS = 50
_NO_ID = -(2**63)


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def with_chunks(docs: DataFrame, name: str = "_chunks", counted: str | None = None) -> DataFrame:
    """Add ``name``: the texts of the document's chunks, in order; joined by newlines they give the text.

    ``counted`` names what ``pair_counts`` found of the document's lines, or null.
    """
    d = docs.withColumn("_lines", F.split("text", "\n"))
    d = d.withColumn("_hashes", F.transform("_lines", line_hash))
    if counted:  # only what fits the lines, one by one
        d = d.withColumn("_pairs", F.when(F.size(F.col(counted)) == F.size("_lines"), F.col(counted)))
    else:
        d = d.withColumn("_pairs", F.lit(None).cast("array<struct<n:long,long:boolean>>"))

    def ends(h: Column, i: Column) -> Column:
        roll, power = h, 1
        for k in range(1, WINDOW):
            power *= BASE
            roll = roll + power * F.coalesce(F.get("_hashes", i - k), F.lit(0))
        found = roll % PRIME % MEAN_LINES == 0
        if counted:
            at = lambda k: F.get("_pairs", i + k)
            rarer = F.coalesce(at(0)["n"] < at(-1)["n"], F.lit(False)) | F.coalesce(at(0)["n"] < at(1)["n"], F.lit(False))
            alone = F.coalesce(at(0)["long"], F.lit(False)) | F.coalesce(at(1)["long"], F.lit(False))
            found = found & (F.coalesce(at(0)["n"], F.lit(1)) == 1) | rarer | alone
        return F.when(found | (i == F.size("_hashes") - 1), i)

    d = d.withColumn("_ends", F.filter(F.transform("_hashes", ends), lambda x: x.isNotNull()))
    start = lambda k: F.coalesce(F.get("_ends", k - 1) + 1, F.lit(0))
    chunks = F.transform("_ends", lambda e, k: F.array_join(F.slice("_lines", start(k) + 1, e - start(k) + 1), "\n"))
    return d.withColumn(name, chunks).drop("_lines", "_hashes", "_ends", "_pairs")


def pair_counts(docs: DataFrame) -> DataFrame:
    """(id, counted): of every line how often it and the next one occur as neighbours, and whether it is long and repeats.

    Only documents in which anything repeats; written down, as it is read twice.
    """
    d = docs.select(_id().alias("id"), F.split("text", "\n").alias("lines"))
    d = d.select("id", "lines", F.transform("lines", lambda x: F.xxhash64(x)).alias("h"))
    pairs = F.transform("h", lambda x, k: F.struct(k.alias("k"), F.lit(0).alias("kind"), F.when(k < F.size("h") - 1, F.xxhash64(x, F.get("h", k + 1), F.lit(0))).alias("h")))
    longs = F.transform("lines", lambda x, k: F.when(F.length(x) >= 2 * LEAST_WORDS - 1, F.struct(k.alias("k"), F.lit(1).alias("kind"), F.when(F.regexp_count(x, F.lit(WORD)) >= LEAST_WORDS, F.get("h", k)).alias("h"))))
    rows = d.select("id", F.explode(F.concat(pairs, F.filter(longs, lambda x: x["h"].isNotNull()))).alias("r")).select("id", "r.*")
    often = rows.where("h is not null").groupBy("kind", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    marked = rows.join(often, ["kind", "h"], "left").select("id", F.struct("k", "kind", F.coalesce("n", F.lit(1)).alias("n")).alias("r"), "n")
    of = marked.groupBy("id").agg(F.sort_array(F.collect_list("r")).alias("r"), F.max("n").alias("most")).where("most is not null")
    after = lambda i: F.get("r", i + 1)  # noqa: E731  (a long line's own entry follows that of its pair)
    dense = F.transform("r", lambda x, i: F.when(x["kind"] == 0, F.struct(x["n"].alias("n"), F.coalesce((after(i)["kind"] == 1) & (after(i)["n"] > 1), F.lit(False)).alias("long"))))
    return cut(of.select("id", F.filter(dense, lambda x: x.isNotNull()).alias("counted")))


def _word_lines(chunk: Column) -> Column:
    return F.size(F.filter(F.split(chunk, "\n"), lambda x: F.translate(x, BLANKS, "") != ""))


def _id() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit(_NO_ID))


COUNTS = ("n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines")


def _lines_in(chunks: Column) -> Column:
    return F.aggregate(chunks, F.lit(0).cast("long"), lambda s, c: s + F.length(c) - F.length(F.translate(c, "\n", "")) + 1)


def dedup_lines(docs: DataFrame, passages: bool = False) -> DataFrame:
    """``docs`` with cleaned text, and n_lines, n_chunks, n_removed_chunks, n_removed_lines."""
    found = pair_counts(docs) if passages else None
    narrow = docs.select(_id().alias("id"), "text")
    narrow = with_chunks(narrow.join(found, "id", "left"), counted="counted") if passages else with_chunks(narrow)
    # The outer form: for a plain explode, a filter on the size of the chunks would be pushed to the scan, and inlined there.
    rows = narrow.select("id", F.posexplode_outer("_chunks").alias("k", "chunk"))
    enough = _word_lines(F.col("chunk")) >= LEAST_LINES
    if passages:
        enough = enough | (F.regexp_count("chunk", F.lit(WORD)) >= LEAST_WORDS)
    rows = rows.where(enough).withColumn("h", F.xxhash64("chunk"))
    firsts = rows.groupBy("h", "chunk").agg(F.min(F.struct("id", "k")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    hits = rows.select("id", "k", "h").join(firsts, "h").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "first", "chunk"))).alias("hits"))
    boxed = docs.select(F.struct(*own(docs.drop("text"))).alias("row"), _id().alias("id"), "text")
    joined = boxed.join(hits, "id", "left")
    d = with_chunks(joined.join(found, "id", "left"), counted="counted") if passages else with_chunks(joined)  # cut into chunks behind the shuffle, which so carries one copy of the text
    here = lambda x: (F.get("_chunks", x["k"]) == x["chunk"]) & ((x["first"]["id"] != F.col("id")) | (x["first"]["k"] != x["k"]))
    d = d.withColumn("gone", F.coalesce(F.transform(F.filter("hits", here), lambda x: x["k"]), F.array().cast("array<int>")))
    # What stays are the stretches between the places of what goes.
    before, after = F.concat(F.array(F.lit(-1)), F.col("gone")), F.concat(F.col("gone"), F.array(F.size("_chunks")))
    kept = F.flatten(F.zip_with(before, after, lambda a, b: F.slice("_chunks", a + 2, F.greatest(b - a - 1, F.lit(0)))))
    d = d.withColumns({"text": F.when(F.size("gone") > 0, F.array_join(kept, "\n")).otherwise(F.col("text")), "out": F.transform("gone", lambda k: F.get("_chunks", k))})
    long = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    d = d.withColumns(
        {
            "n_lines": long(_lines_in(F.col("_chunks"))),
            "n_chunks": long(F.when(F.col("_chunks").isNotNull(), F.size("_chunks"))),
            "n_removed_chunks": long(F.size("gone")),
            "n_removed_lines": long(_lines_in(F.col("out"))),
        }
    )
    # A caller's filter on the new columns must not be pushed below them: nested lambdas would be inlined into
    # one another and evaluated for every element. The partition's number, not deterministic, holds it here.
    d = d.withColumn("_here", F.spark_partition_id()).where("_here >= 0")
    columns = [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in COUNTS]
    return d.select(*columns, *COUNTS)


def oracle() -> str:
    roll = "h[i]" + "".join(f" + {BASE**k} * coalesce(h[i - {k}], 0)" for k in range(1, WINDOW))
    return f"""
    with l as (select doc_id, text, string_split(text, chr(10)) as lines from documents),
    a as (select *, list_transform(lines, lambda x: ('0x' || substr(md5(x), 1, 7))::bigint) as h from l),
    u as (select doc_id, a.lines, a.h, unnest(range(1, len(a.lines) + 1)) as i from a where text is not null),
    e as (select doc_id, i, lines[i] as line, ({roll}) % {PRIME} % {MEAN_LINES} = 0 as ends from u),
    n as (select *, coalesce(sum(ends::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as k from e),
    c as (select doc_id, k, string_agg(line, chr(10) order by i) as chunk, count(*) as lines,
                 count(*) filter (regexp_matches(line, '[^\\x20\\x09-\\x0D]')) as wordy from n group by doc_id, k),
    f as (select *, row_number() over (partition by chunk order by doc_id, k) > 1 and wordy >= {LEAST_LINES} as gone from c),
    r as (select doc_id, coalesce(string_agg(chunk, chr(10) order by k) filter (not gone), '') as text, sum(lines)::bigint as n_lines, count(*)::bigint as n_chunks,
                 count(*) filter (gone)::bigint as n_removed_chunks, coalesce(sum(lines) filter (gone), 0)::bigint as n_removed_lines from f group by doc_id)
    select d.doc_id, r.text, coalesce(n_lines, 0) as n_lines, coalesce(n_chunks, 0) as n_chunks, coalesce(n_removed_chunks, 0) as n_removed_chunks, coalesce(n_removed_lines, 0) as n_removed_lines
    from documents d left join r on r.doc_id = d.doc_id
    """
