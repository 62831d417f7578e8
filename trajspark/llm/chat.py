"""Chat formatting: tool calls linked to their results, ordered, validated and serialised.

Calls and results meet in a hash join on (conversation, identifier). A call may name a parent call;
the depth of every call in this forest is found by pointer doubling, in as many joins as the
logarithm of the longest chain, whatever order the messages came in, so (depth, turn, identifier)
is a topological order. Calls on or behind a cycle never reach a root and are flagged. Arguments are
parsed as JSON variants and checked against the schema of the tool's name. Each record is one line
of canonical JSON: keys sorted at every level, no blanks, equal numbers written alike (1.0 and 1e0 as 1,
0.50 as 0.5), null members of arguments kept, null members of the record itself left out.

DataFrame and SQL expressions only. One row a record: a conversation of any length is never
gathered in one place.

Defined results. A null or unparsable arguments text is invalid ('json'); an unknown tool is invalid
('tool'). Of calls that share an identifier within a conversation the smallest (turn, arguments, name,
parent) is linked, of results the smallest (turn, content). With ``every_row``, each of the others is a
record of its own, flagged 'duplicate': a call one level below its parent, a result as an orphan; and the
linked call has the status it would have alone. Without it they are left out, and the linked call is
flagged 'duplicate'. Results without a call come as orphans at depth 0; a call without a result has a null
one. Null conversation or identifier: never linked, but returned. A turn of null role counts as a result
nobody asked for. An empty input gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: What a tool's arguments must hold: name -> {field: (type, required, least, most)}; bounds are of lengths for strings.
Schema = Mapping[str, tuple[str, bool, int | None, int | None]]
TURN_TOOLS: Mapping[str, Schema] = {
    "reply": {"chars": ("integer", True, 1, 400), "text": ("string", True, 1, 400)},
    "brief": {"chars": ("integer", True, 1, 120), "text": ("string", True, 1, 120)},
}
_TYPES = {"integer": "bigint", "number": "double", "string": "string", "boolean": "boolean"}


def invalid(arguments: Column, name: Column, tools: Mapping[str, Schema]) -> Column:
    """Null if ``arguments``, a variant, meet the schema of ``name``; else the first field that doesn't, or 'tool' or 'json'."""
    out = F.lit("tool")
    for tool, schema in tools.items():
        checks = []
        for field, (kind, required, least, most) in sorted(schema.items()):
            v = F.try_variant_get(arguments, f"$.{field}", _TYPES[kind])
            raw = F.try_variant_get(arguments, f"$.{field}", "variant")
            size = F.length(v) if kind == "string" else v
            right = F.schema_of_variant(raw).isin({"integer": ["BIGINT"], "string": ["STRING"], "boolean": ["BOOLEAN"]}.get(kind, ["BIGINT", "DOUBLE", "DECIMAL"])) if kind != "number" else v.isNotNull()
            bad = ~F.coalesce(right & v.isNotNull(), F.lit(False))
            if least is not None:
                bad = bad | F.coalesce(size < least, F.lit(False))
            if most is not None:
                bad = bad | F.coalesce(size > most, F.lit(False))
            if not required:
                bad = bad & raw.isNotNull()
            checks.append(F.when(bad, F.lit(field)))
        out = F.when(name == tool, F.coalesce(F.lit(None).cast("string"), *checks)).otherwise(out)
    return F.when(arguments.isNull(), F.lit("json")).otherwise(out)


def _number(token: Column) -> Column:
    """A JSON number in its one form: whole ones of up to 38 digits without point or exponent, others as the shortest double."""
    whole = F.regexp_replace(token, "^-0$", "0")
    wide = token.try_cast("double")
    exact = token.try_cast("decimal(38,10)")
    integral = F.when(wide == F.rint(wide), F.coalesce(F.when(exact == F.floor(exact), F.floor(exact).cast("string")), wide.try_cast("decimal(38,0)").cast("string")))
    return F.when(~token.rlike("[.eE]"), whole).otherwise(F.coalesce(integral, F.when(F.abs(wide) < float("inf"), wide.cast("string")), token))


def canonical(json: Column) -> Column:
    """JSON text, already of sorted keys and without blanks, with its numbers in their one form.

    Split at the quotes that open or close strings, every other part lies outside of them. Escaped
    backslashes and quotes are set aside as control characters, which JSON text holds in escaped form only.
    """
    aside = F.replace(F.replace(json, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    outside = lambda part: F.array_join(F.transform(F.regexp_extract_all(part, F.lit("(-?[0-9][0-9.eE+-]*|[^0-9-]+|-)"), 1), lambda t: F.when(t.rlike("^-?[0-9]"), _number(t)).otherwise(t)), "")
    parts = F.transform(F.split(aside, '"', -1), lambda part, i: F.when((i % 2 == 0) & part.rlike("[0-9]"), outside(part)).otherwise(part))
    back = F.replace(F.replace(F.array_join(parts, '"'), F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
    return F.when(json.rlike("[0-9][.eE]|-0"), back).otherwise(json)


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth) of unique calls with a parent_id: 0 for roots, null on or behind a cycle.

    Each round doubles the distance a pointer spans. A parent that is not a call of the conversation counts as none.
    """
    ids = calls.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_up"))
    known = calls.join(ids, (F.col("conv_id") == F.col("_c")) & (F.col("parent_id") == F.col("_up")), "left")
    now = cut(known.select("conv_id", "call_id", F.col("_up").alias("up"), F.when(F.col("_up").isNull(), 0).otherwise(1).cast("long").alias("span")))
    open_, rounds = now.where("up is not null").count(), 0
    most = now.count()
    while open_ and 2**rounds <= 2 * most:
        step = now.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"), F.col("up").alias("_up2"), F.col("span").alias("_span2"))
        joined = now.join(step, (F.col("conv_id") == F.col("_c")) & (F.col("up") == F.col("_i")), "left")
        now = cut(joined.select("conv_id", "call_id", F.col("_up2").alias("up"), F.when(F.col("up").isNull(), F.col("span")).otherwise(F.col("span") + F.col("_span2")).alias("span")))
        left, rounds = now.where("up is not null").count(), rounds + 1
        open_ = left
    return now.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("span")).alias("depth"))


def _others(rows: DataFrame, firsts: DataFrame, fields: list[str]) -> DataFrame:
    """``rows`` but for one copy of each of ``firsts`` (conv_id, call_id, _first): equal rows are counted, not gathered."""
    of = F.struct(*fields)
    rows = rows.join(firsts, ["conv_id", "call_id"]).groupBy("conv_id", "call_id", *fields, of.eqNullSafe(F.col("_first")).alias("_kept")).agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.withColumn("_n", F.col("_n") - F.col("_kept").cast("long")).where("_n > 0")
    return rows.select("conv_id", "call_id", *fields, F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_n")).drop("_n")


def link(calls: DataFrame, results: DataFrame, tools: Mapping[str, Schema], every_row: bool = False) -> DataFrame:
    """Calls (conv_id, turn, call_id, parent_id, name, arguments) and results (conv_id, turn, call_id, content) as ordered records.

    Returns conv_id, call_id, kind ('call' or 'orphan'), turn, result_turn, depth, status and json.
    """
    calls = calls.select("conv_id", F.col("turn").cast("long").alias("turn"), "call_id", "parent_id", "name", "arguments")
    results = results.select("conv_id", F.col("turn").cast("long").alias("turn"), "call_id", "content")
    linked = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first = calls.where(linked).groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "arguments", "name", "parent_id")).alias("c"), F.count(F.lit(1)).alias("n")
    )
    unique = first.select("conv_id", "call_id", "c.*", (F.col("n") - 1).alias("repeats"))
    answer = results.where(linked).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    deep = depths(unique)
    placed = unique.join(deep, ["conv_id", "call_id"]).join(answer, ["conv_id", "call_id"], "full")
    loose_calls = calls.where(~linked).select("conv_id", "call_id", "turn", "arguments", "name", "parent_id", F.lit(0).cast("long").alias("repeats"), F.lit(0).cast("long").alias("depth"), F.lit(True).alias("is_call"))
    loose_results = results.where(~linked).select("conv_id", "call_id", F.struct("turn", "content").alias("r"), F.lit(1).cast("long").alias("n_results"), F.lit(False).alias("is_call"))
    placed = placed.withColumn("is_call", F.col("repeats").isNotNull())
    every = placed.unionByName(loose_calls, allowMissingColumns=True).unionByName(loose_results, allowMissingColumns=True)
    every = every.withColumn("_repeat", F.lit(False))
    if every_row:
        again = _others(calls, first.where("n > 1").select("conv_id", "call_id", F.col("c").alias("_first")), ["turn", "arguments", "name", "parent_id"])
        up = deep.select("conv_id", F.col("call_id").alias("parent_id"), F.col("depth").alias("_up"), F.lit(True).alias("_known"))
        again = again.join(up, ["conv_id", "parent_id"], "left").withColumn("depth", F.when(F.col("_known"), F.col("_up") + 1).otherwise(0).cast("long")).drop("_up", "_known")
        late = _others(results, answer.where("n_results > 1").select("conv_id", "call_id", F.col("r").alias("_first")), ["turn", "content"])
        late = late.select("conv_id", "call_id", F.struct("turn", "content").alias("r"))
        for rows, is_call in ((again, True), (late, False)):
            every = every.unionByName(rows.withColumns({"is_call": F.lit(is_call), "_repeat": F.lit(True)}), allowMissingColumns=True)
    every = every.withColumn("_args", F.try_parse_json("arguments"))
    every = every.withColumn("_bad", F.when(F.col("is_call"), invalid(F.col("_args"), F.col("name"), tools)))
    status = (
        F.when(F.col("_repeat"), "duplicate")
        .when(~F.col("is_call"), "orphan")
        .when(F.col("depth").isNull(), "cycle")
        .when(F.lit(not every_row) & (F.col("repeats") > 0), "duplicate")
        .when(F.col("_bad").isNotNull(), F.concat(F.lit("invalid:"), F.col("_bad")))
        .when(F.col("r").isNull(), "unanswered")
        .otherwise("ok")
    )
    record = F.struct(
        F.col("_args").alias("arguments"),
        F.col("call_id").alias("id"),
        F.col("name").alias("name"),
        F.col("parent_id").alias("parent"),
        F.col("r.content").alias("result"),
    )
    return every.select(
        "conv_id",
        "call_id",
        F.when(F.col("is_call"), "call").otherwise("orphan").alias("kind"),
        F.col("turn"),
        F.col("r.turn").alias("result_turn"),
        F.when(F.col("is_call"), F.col("depth")).otherwise(0).cast("long").alias("depth"),
        status.alias("status"),
        canonical(F.to_json(record)).alias("json"),
    )


def from_turns(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations (conv_id, turn, role, text), by a fixed reading.

    Every user turn calls the tool 'brief' (texts of up to 120 characters) or 'reply' with its text; the
    assistant turn that follows at once answers it; the call two turns earlier is its parent. System turns,
    and those of null role, are results nobody asked for.
    """
    m = messages.select("conv_id", "turn", "role", "text")
    name = F.when(F.length("text") <= 120, "brief").otherwise("reply")
    ident = lambda back: F.concat(F.lit("t"), (F.col("turn") - back).cast("string"))
    args = F.to_json(F.struct(F.col("text").alias("text"), F.length("text").alias("chars")))
    calls = m.where("role = 'user'").select("conv_id", "turn", ident(0).alias("call_id"), ident(2).alias("parent_id"), name.alias("name"), args.alias("arguments"))
    results = m.where("not role <=> 'user'").select("conv_id", "turn", F.when(F.col("role") == "assistant", ident(1)).otherwise(ident(0)).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def oracle() -> str:
    """The reading of plain conversations in SQL: chains of parents are walked by recursion."""
    return r"""
    with recursive c as (select conv_id, turn::bigint as turn, 't' || turn as call_id, 't' || (turn - 2) as parent_id,
                case when length(text) <= 120 then 'brief' else 'reply' end as name, text, length(text) as chars from conversations where role = 'user'),
    r as (select conv_id, turn::bigint as turn, 't' || case when role = 'assistant' then turn - 1 else turn end as call_id, text from conversations where role <> 'user'),
    w as (select conv_id, call_id, 0 as depth from c where not exists (select 1 from c p where p.conv_id = c.conv_id and p.call_id = c.parent_id)
          union all select c.conv_id, c.call_id, w.depth + 1 from w join c on c.conv_id = w.conv_id and c.parent_id = w.call_id),
    j as (select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.call_id, r.call_id) as call_id, c.turn, r.turn as result_turn, w.depth, c.call_id is not null as is_call,
                 c.name, c.parent_id, c.text, c.chars, r.text as content, r.call_id is not null as answered
          from c left join w on w.conv_id = c.conv_id and w.call_id = c.call_id full join r on r.conv_id = c.conv_id and r.call_id = c.call_id)
    select conv_id, call_id, case when is_call then 'call' else 'orphan' end as kind, turn, result_turn, coalesce(depth, 0)::bigint as depth,
           case when not is_call then 'orphan' when chars is null or chars < 1 or chars > 400 then 'invalid:chars' when not answered then 'unanswered' else 'ok' end as status,
           '{' || array_to_string(list_filter([
             case when is_call then '"arguments":{' || array_to_string(list_filter(['"chars":' || chars, '"text":' || to_json(text)::varchar], lambda x: x is not null), ',') || '}' end,
             '"id":' || to_json(call_id)::varchar, '"name":' || to_json(name)::varchar, '"parent":' || to_json(parent_id)::varchar, '"result":' || to_json(content)::varchar
           ], lambda x: x is not null), ',') || '}' as json
    from j
    """
