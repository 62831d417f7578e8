"""Quality rules whose cutoffs come from mergeable quantile sketches per language and source.

Everything on the path is DataFrame/SQL expressions. A sketch is a log-linear histogram: a
non-negative integer measure falls into a bucket whose width is at most 1/16 of its lower edge, so
two sketches merge by adding counts, in any order, and give the same quantiles however the rows are
partitioned. Sketches are built once per (lang, source); those of languages and of the corpus are
sums of them.

Defined results. Null text counts as an empty text (all counts 0, ``base_failed``). A very long text is
measured whole, in time that grows with it by n log n at most. Null lang or source is a group of its own. Ties and repeated rows count as often as they occur. An empty table
gives an empty result. Columns of the input other than doc_id, text, lang and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, cut, key_of, own, unused

SYMBOLS = "#*$%&|<>"
#: Measures in integer parts: (name, numerator, denominator, parts).
MEASURES = (
    ("word_len", "word_chars", "n_words", 100),
    ("symbols", "n_symbols", "word_chars", 10_000),
    ("dup_lines", "n_dup_lines", "n_words", 10_000),
    ("repeats", "n_repeat_words", "n_words", 1_000),
)
#: A verdict needs the measure beyond median + SPREADS * (upper - median) + slack, or below the mirrored bound.
SPREADS = 6
#: Slack in the measure's own parts: what no document is rejected for, however narrow its group is.
SLACK = {"word_len": 100, "symbols": 300, "dup_lines": 150, "repeats": 200}
TWO_SIDED = ("word_len",)
UPPER_Q = 0.75
#: Groups with fewer passing documents than this borrow the sketch of their language, then the corpus's.
LEAST_GROUP = 200


def _windows(words: Column) -> Column:
    """64-bit hashes of the 3-word windows, in order."""
    n = F.size(words) - 2
    return F.when(n >= 2, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))


def _repeat_words(hashes: Column) -> Column:
    """Positions covered by windows that occur at least twice.

    A text without a repeat, as most are, is told by its distinct hashes. Else the hashes are sorted with
    their positions, equal neighbours are repeats, and sorted repeat positions p1 < p2 < ... cover
    sum(min(3, p - previous p)) words.
    """
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ahead = F.slice(pairs, 2, F.size(hashes))
    marked = F.zip_with(pairs, ahead, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    at = F.sort_array(F.array_distinct(F.flatten(F.filter(marked, lambda x: x.isNotNull()))))
    covered = F.aggregate(
        at,
        F.struct(F.lit(0).cast("long").alias("c"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["c"] + F.least(F.lit(3), p - a["last"])).alias("c"), p.alias("last")),
        lambda a: a["c"],
    )
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame) -> DataFrame:
    """The base counts of every whole text; other columns pass through."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("_words", F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "_lines": lines,
            "_windows": _windows(F.col("_words")),
        }
    )
    out = out.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    out = out.withColumn("n_repeat_words", _repeat_words(F.col("_windows")))
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.drop("_words", "_lines", "_windows")


def bucket(v: Column) -> Column:
    """Log-linear bucket of a non-negative integer: exact below 32, then 16 buckets for each power of two."""
    e = F.length(F.bin(v)) - 5
    return F.when(v < 32, v).otherwise(16 * e + F.floor(v / F.pow(F.lit(2.0), e))).cast("long")


def bucket_top(b: Column) -> Column:
    """The largest integer of a bucket."""
    e = F.greatest(F.floor(b / 16) - 1, F.lit(0))
    return F.when(b < 32, b).otherwise((b - 16 * e + 1) * F.pow(F.lit(2.0), e) - 1).cast("long")


def _value(num: str, den: str, parts: int) -> Column:
    return F.floor(parts * F.col(num) / F.col(den)).cast("long")


def sketches(measured: DataFrame) -> DataFrame:
    """(lang key, source key, measure, bucket, n) over the documents that pass the base rules."""
    each = F.array(*[F.struct(F.lit(m).alias("measure"), bucket(_value(a, b, k)).alias("bucket")) for m, a, b, k in MEASURES])
    rows = measured.where(~F.col("base_failed")).select(key_of(F.col("lang")).alias("lk"), key_of(F.col("source")).alias("sk"), F.inline(each))
    return rows.groupBy("lk", "sk", "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Median, lower and upper quantile of each (keys, measure), by merging and walking the sketch."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "measure")
    walked = merged.select("*", F.sum("n").over(w.orderBy("bucket")).alias("upto"), F.sum("n").over(w).alias("total"))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bucket")))
    return walked.groupBy(*keys, "measure").agg(
        F.max("total").alias("total"),
        bucket_top(at(1 - UPPER_Q)).alias("lower"),
        bucket_top(at(0.5)).alias("mid"),
        bucket_top(at(UPPER_Q)).alias("upper"),
    )


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source): the highest and lowest value kept of each measure.

    A group's own quantiles count only where it has ``LEAST_GROUP`` documents; a smaller one takes
    its language's, and a small language the corpus's.
    """
    own, lang, whole = quantiles(sketch, ["lk", "sk"]), quantiles(sketch, ["lk"]), quantiles(sketch, [])
    take = lambda t, p: [F.col(f"{t}.{c}").alias(f"{p}_{c}") for c in ("total", "lower", "mid", "upper")]
    j = (
        own.alias("o")
        .join(lang.alias("l"), ["lk", "measure"])
        .join(whole.alias("w"), ["measure"])
        .select("lk", "sk", "measure", *take("o", "o"), *take("l", "l"), *take("w", "w"))
    )
    pick = lambda c: F.when(F.col("o_total") >= LEAST_GROUP, F.col(f"o_{c}")).when(F.col("l_total") >= LEAST_GROUP, F.col(f"l_{c}")).otherwise(F.col(f"w_{c}"))
    j = j.select("lk", "sk", "measure", pick("lower").alias("lower"), pick("mid").alias("mid"), pick("upper").alias("upper"))
    slack = F.create_map(*[x for m, v in SLACK.items() for x in (F.lit(m), F.lit(v))])[F.col("measure")]
    j = j.withColumn("most", F.col("mid") + SPREADS * (F.col("upper") - F.col("mid")) + slack)
    j = j.withColumn("least", F.col("mid") - SPREADS * (F.col("mid") - F.col("lower")) - slack)
    bounds = [F.max(F.when(F.col("measure") == m, F.col("most"))).alias(f"{m}_most") for m, *_ in MEASURES]
    bounds += [F.max(F.when(F.col("measure") == m, F.col("least"))).alias(f"{m}_least") for m in TWO_SIDED]
    return j.groupBy("lk", "sk").agg(*bounds)


def verdicts(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Join each document with its group's limits and add ``kept``."""
    ok = ~F.col("base_failed")
    for m, a, b, k in MEASURES:
        v = _value(a, b, k)
        good = v <= F.col(f"{m}_most")
        if m in TWO_SIDED:
            good = good & (v >= F.col(f"{m}_least"))
        ok = ok & F.coalesce(good, F.lit(True))
    keyed = measured.withColumns({"lk": key_of(F.col("lang")), "sk": key_of(F.col("source"))})
    joined = keyed.join(limits, ["lk", "sk"], "left")
    names = [c for c in limits.columns if c not in ("lk", "sk")]
    return joined.withColumn("kept", ok).drop("lk", "sk", *names)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Every document's base counts and verdict: (doc_id, counts, base_failed, kept), without the text.

    The counts are materialised once, without texts, and feed both the sketches and the join.
    """
    narrow = measure(docs.select("doc_id", "text", "lang", "source")).withColumn("text_hash", F.xxhash64("text")).drop("text")
    measured = cut(narrow)
    return verdicts(measured, thresholds(sketches(measured)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns; a null doc_id is an id like any other."""
    key, text = unused(docs.columns, "key"), unused(docs.columns, "text_hash")
    good = quality_rules(docs).where("kept").select(key_of(F.col("doc_id")).alias(key), F.col("text_hash").alias(text))
    keyed = docs.withColumns({key: key_of(F.col("doc_id")), text: F.xxhash64("text")})
    return keyed.join(good, [key, text], "left_semi").select(*own(docs))


def oracle() -> str:
    """The same rules for DuckDB, from the same parameters."""
    nl, ws = "chr(10)", "'[\\x20\\x09-\\x0D]+'"
    base = f"""
    with d as (select doc_id, coalesce(text, '') as text, lang, source from documents),
    w as (select *, list_filter(regexp_split_to_array(text, {ws}), lambda x: x <> '') as words,
                 list_filter(string_split(text, {nl}), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from d),
    g as (select doc_id, w.words, unnest(range(1, len(w.words) - 1)) as i from w where len(w.words) >= 3),
    f as (select doc_id, i, count(*) over (partition by doc_id, words[i], words[i + 1], words[i + 2]) as n from g),
    p as (select distinct doc_id, unnest([i, i + 1, i + 2]) as at from f where n > 1),
    c as (select doc_id, count(*) as covered from p group by doc_id),
    m as (select w.doc_id, lang, source, len(words)::bigint as n_words,
                 length(regexp_replace(text, {ws}, '', 'g'))::bigint as word_chars,
                 (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
                 (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
                 coalesce(covered, 0)::bigint as n_repeat_words
          from w left join c on c.doc_id = w.doc_id),
    b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m),
    """
    value = {m: f"({k} * {a}) // nullif({b}, 0)" for m, a, b, k in MEASURES}
    rows = " union all ".join(f"select doc_id, lang, source, '{m}' as measure, {v} as v from b where not base_failed" for m, v in value.items())
    sketch = f"""
    r as ({rows}),
    k as (select lang, source, measure, case when v < 32 then v else 16 * (length(bin(v)) - 5) + (v >> (length(bin(v)) - 5)::int) end as bucket from r),
    """
    parts = []
    for name, keys in (("qo", "lang, source, "), ("ql", "lang, "), ("qw", "")):
        parts.append(f"""
    {name}1 as (select {keys}measure, bucket, count(*) as n from k group by all),
    {name}2 as (select *, sum(n) over (partition by {keys}measure order by bucket) as upto, sum(n) over (partition by {keys}measure) as total from {name}1),
    {name}3 as (select {keys}measure, max(total) as total, min(case when upto >= {1 - UPPER_Q} * total then bucket end) as lo,
                min(case when upto >= 0.5 * total then bucket end) as mi, min(case when upto >= {UPPER_Q} * total then bucket end) as up from {name}2 group by all),
    {name} as (select * replace ({", ".join(f"case when {c} < 32 then {c} else (({c} - 16 * ({c} // 16 - 1) + 1) * (2 ** ({c} // 16 - 1)))::bigint - 1 end as {c}" for c in ("lo", "mi", "up"))}) from {name}3),
    """)
    pick = lambda c: f"case when qo.total >= {LEAST_GROUP} then qo.{c} when ql.total >= {LEAST_GROUP} then ql.{c} else qw.{c} end"
    slack = "case measure " + " ".join(f"when '{m}' then {v}" for m, v in SLACK.items()) + " end"
    limits = f"""
    t0 as (select qo.lang, qo.source, qo.measure, {pick("lo")} as lo, {pick("mi")} as mi, {pick("up")} as up
           from qo join ql on qo.lang is not distinct from ql.lang and qo.measure = ql.measure join qw on qo.measure = qw.measure),
    t as (select lang, source, {", ".join([f"max(case when measure = '{m}' then mi + {SPREADS} * (up - mi) + {slack} end) as {m}_most" for m, *_ in MEASURES] + [f"max(case when measure = '{m}' then mi - {SPREADS} * (mi - lo) - {slack} end) as {m}_least" for m in TWO_SIDED])}
          from t0 group by lang, source)
    """
    good = " and ".join(f"coalesce({value[m]} <= {m}_most" + (f" and {value[m]} >= {m}_least" if m in TWO_SIDED else "") + ", true)" for m, *_ in MEASURES)
    return (
        base + sketch + "".join(parts) + limits + f"select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {good} as kept "
        "from b left join t on b.lang is not distinct from t.lang and b.source is not distinct from t.source"
    )
