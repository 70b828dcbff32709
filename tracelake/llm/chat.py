"""Chat formatting with linked tool calls, in DataFrame functions only.

A tool call is an element of ``tool_calls`` in an assistant message whose text is a JSON object:
``{"id", "name", "arguments"}``, or the same two under ``function``; arguments are an object or a
string that holds one.  A tool result is a message of role ``tool`` whose text is a JSON object with
``tool_call_id`` and ``content``.

Calls and results are hash-joined by conversation and identifier.  Of several calls (or results)
with one identifier the first counts, found by an aggregation with partial results, and the others
are marked; so neither a hot conversation nor a repeated identifier makes pairs or a large group.
Arguments are validated against schemas that are joined by tool name.

The result has one row an event, ordered topologically by (order_turn, order_phase, order_no):
a result never comes before its call.  Events are not gathered into one document a conversation,
as a conversation may hold a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import cut

#: Schemas are broadcast up to this many rows, else joined with a shuffle.
BROADCAST_SCHEMAS = 10_000

SCHEMA = "name string, parameter string, type string, required boolean"
#: Parameter types: what schema_of_variant says of a value of that type begins with one of these.
TYPES = {
    "string": ("STRING",),
    "integer": ("BIGINT",),
    "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"),
    "boolean": ("BOOLEAN",),
    "array": ("ARRAY",),
    "object": ("OBJECT",),
    "null": ("VOID",),
}


def no_schemas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _json(**fields: Column) -> Column:
    """Canonical JSON: keys in order, no white space, nulls left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def _validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` with ``errors``, an array in order; null if the tool has no schema."""
    spec = F.struct(F.col("parameter"), F.col("type"), F.col("required"))
    by_tool = schemas.where("name is not null").groupBy("name").agg(F.array_sort(F.collect_set(F.when(F.col("parameter").isNotNull(), spec))).alias("spec"))
    if schemas.limit(BROADCAST_SCHEMAS + 1).count() <= BROADCAST_SCHEMAS:
        by_tool = F.broadcast(by_tool)
    given = F.col("given")
    has = lambda p: F.array_contains(F.map_keys(given), p)
    kind = lambda p: F.schema_of_variant(F.element_at(given, p))
    fits = lambda s: F.coalesce(
        *[F.when(s["type"] == t, F.lit(False) if not starts else F.greatest(*[F.startswith(kind(s["parameter"]), F.lit(x)) for x in starts], F.lit(False))) for t, starts in TYPES.items()], F.lit(True)
    )
    missing = F.transform(F.filter("spec", lambda s: s["required"] & ~has(s["parameter"])), lambda s: F.concat(F.lit("missing "), s["parameter"]))
    wrong = F.transform(F.filter("spec", lambda s: has(s["parameter"]) & ~fits(s)), lambda s: F.concat(F.lit("not "), s["type"], F.lit(" "), s["parameter"]))
    known = F.transform("spec", lambda s: s["parameter"])
    extra = F.transform(F.array_except(F.map_keys(given), known), lambda p: F.concat(F.lit("unknown "), p))
    errors = F.when(given.isNull(), F.array(F.lit("arguments are no object"))).otherwise(F.array_sort(F.concat(missing, wrong, extra)))
    return calls.join(by_tool, "name", "left").withColumn("errors", F.when(F.col("spec").isNotNull(), errors)).drop("spec")


#: Copies of a row that one array numbers.
COPIES = 1 << 16


def _copies(df: DataFrame) -> DataFrame:
    """Each row as often as ``n`` says, numbered by ``copy`` from 0."""
    blocks = df.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    own = F.sequence(F.col("b") * COPIES, F.least(F.col("n"), (F.col("b") + 1) * COPIES) - 1)
    return blocks.withColumn("copy", F.explode(own)).drop("b", "n")


def _parsed(df: DataFrame) -> DataFrame:
    """``df`` with v (the JSON of a text that may hold calls or a result), calls and result_of."""
    object_like = F.col("text").rlike(r"^\s*\{") & F.col("role").isin("assistant", "tool")
    df = df.withColumn("v", F.when(object_like, F.try_parse_json("text")))
    called = F.when(F.col("role") == "assistant", _get(F.col("v"), "$.tool_calls", "array<variant>"))
    return df.withColumns({"calls": called, "result_of": F.when(F.col("role") == "tool", _get(F.col("v"), "$.tool_call_id", "string"))})


def link_tools(df: DataFrame, schemas: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a message, call and result: conv_id, turn, kind, call_id, status, order_turn,
    order_phase, order_no, json.

    - A message that is no JSON object of the shapes above is plain text, whatever its role.
    - status: ``message``; calls ``linked``, ``pending`` (no result), ``duplicate`` (identifier
      seen before) or ``unnamed`` (no identifier); results ``linked``, ``orphan`` or ``duplicate``.
    - json of a call holds its arguments in canonical form, the turn of its result and what
      validation found (``valid`` is left out if the tool has no schema).
    - Null roles and texts are left out of the JSON; rows with null conversation or turn are
      messages too, but link with nothing.  Of repeated rows the calls and results beyond the
      first are duplicates, as are those of other rows of the same turn.  Very long texts stay
      whole.  An empty table gives an empty result.
    """
    schemas = no_schemas(df.sparkSession) if schemas is None else schemas
    said = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    said = _parsed(said)

    plain = F.when(F.size("calls") > 0, _get(F.col("v"), "$.content", "string")).otherwise(F.col("text"))
    messages = said.where("result_of is null").select(
        "conv_id", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit("message").alias("status"),
        F.col("turn").alias("order_turn"), F.lit(0).alias("order_phase"), F.lit(0).alias("order_no"), _json(role=F.col("role"), content=plain).alias("json"),
    )

    rows = said.where("size(calls) > 0 or result_of is not null").groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    tools = _parsed(_copies(cut(rows))).withColumn("h", F.xxhash64("text"))  # read four times
    c = F.col("c")
    arguments = F.coalesce(_get(c, "$.arguments", "variant"), _get(c, "$.function.arguments", "variant"))
    as_text = F.when(F.schema_of_variant(arguments) == "STRING", F.try_parse_json(_get(arguments, "$", "string"))).otherwise(arguments)
    calls = (
        tools.where(F.size("calls") > 0)
        .select("conv_id", "turn", "h", "copy", F.posexplode("calls").alias("no", "c"))
        .select(
            "h", "copy",
            "conv_id", "turn", (F.col("no") + 1).alias("no"), _get(c, "$.id", "string").alias("call_id"),
            F.coalesce(_get(c, "$.name", "string"), _get(c, "$.function.name", "string")).alias("name"), as_text.alias("arguments"),
        )
        .withColumn("given", F.when(F.schema_of_variant("arguments").startswith("OBJECT"), _get(F.col("arguments"), "$", "map<string,variant>")))
    )
    calls = _validated(calls, schemas).withColumn("arguments", F.to_json("arguments")).drop("given")
    results = tools.where("result_of is not null").select(
        "h", "copy", "conv_id", "turn", F.col("result_of").alias("call_id"),
        F.coalesce(_get(F.col("v"), "$.content", "string"), F.to_json(_get(F.col("v"), "$.content", "variant"))).alias("content"),
    )

    key = ["conv_id", "call_id"]
    first_call = calls.where("call_id is not null").groupBy(*key).agg(F.min(F.struct("turn", "no", "h", "copy")).alias("first"))
    first_result = results.groupBy(*key).agg(F.min(F.struct("turn", "h", "copy")).alias("answer"))
    linked = first_call.join(first_result, key, "full")

    own = calls.join(linked, key, "left")
    is_first = F.col("first") == F.struct("turn", "no", "h", "copy")
    call_events = own.select(
        "conv_id", "turn", F.lit("call").alias("kind"), "call_id",
        F.when(F.col("call_id").isNull(), "unnamed").when(~F.coalesce(is_first, F.lit(True)), "duplicate").when(F.col("answer").isNotNull(), "linked").otherwise("pending").alias("status"),
        F.col("turn").alias("order_turn"), F.lit(0).alias("order_phase"), F.col("no").alias("order_no"),
        _json(
            id=F.col("call_id"), name=F.col("name"), arguments=F.col("arguments"), result_turn=F.when(is_first, F.col("answer.turn")),
            errors=F.when(F.size("errors") > 0, F.col("errors")), valid=F.when(F.col("errors").isNotNull(), F.size("errors") == 0),
        ).alias("json"),
    )
    got = results.join(linked, key, "left")
    is_answer = F.col("answer").eqNullSafe(F.struct("turn", "h", "copy"))
    late = F.col("first.turn") >= F.col("turn")
    result_events = got.select(
        "conv_id", "turn", F.lit("result").alias("kind"), "call_id",
        F.when(F.col("first").isNull(), "orphan").when(~is_answer, "duplicate").otherwise("linked").alias("status"),
        F.greatest(F.col("turn"), F.col("first.turn")).alias("order_turn"), F.when(late, 1).otherwise(0).alias("order_phase"),
        F.when(late, F.col("first.no")).otherwise(0).alias("order_no"),
        _json(role=F.lit("tool"), id=F.col("call_id"), content=F.col("content"), call_turn=F.col("first.turn")).alias("json"),
    )
    return messages.unionByName(call_events).unionByName(result_events)


#: Schema of the tool of :func:`with_lookups`.
LOOKUP = (("lookup", "limit", "integer", True), ("lookup", "query", "string", True))


def with_lookups(df: DataFrame) -> DataFrame:
    """Plain conversations as if each user message were looked up by a tool and each assistant message
    were what the tool found: turn t becomes 3 t, a call stands at 3 t + 1, a result at 3 t - 1 (at
    3 t - 3, before its call, in every fifth conversation).  Every fourth turn passes a limit that is
    no number, another fourth no query."""
    t, text = F.col("turn"), F.col("text")
    arguments = (
        F.when(t % 4 == 0, F.to_json(F.struct(F.lit("many").alias("limit"), text.alias("query"))))
        .when(t % 4 == 2, F.to_json(F.struct(t.alias("limit"))))
        .otherwise(F.to_json(F.struct(t.alias("limit"), text.alias("query"))))
    )
    call = F.struct(F.concat(F.lit("q"), t.cast("string")).alias("id"), F.lit("lookup").alias("name"), arguments.alias("arguments"))
    result = F.struct(F.concat(F.lit("q"), (t - 1).cast("string")).alias("tool_call_id"), text.alias("content"))
    row = lambda at, role, x: F.struct(at.cast("long").alias("turn"), role.alias("role"), x.alias("text"))
    rows = [
        row(t * 3, F.col("role"), text),
        F.when(F.col("role") == "user", row(t * 3 + 1, F.lit("assistant"), F.to_json(F.struct(F.array(call).alias("tool_calls"))))),
        F.when(F.col("role") == "assistant", row(F.when(F.col("conv_id") % 5 == 0, t * 3 - 3).otherwise(t * 3 - 1), F.lit("tool"), F.to_json(result))),
    ]
    return df.select("conv_id", F.inline(F.array_compact(F.array(*rows))))


#: :func:`link_tools` of :func:`with_lookups`, for conversations without nulls, repeated turns and
#: tool calls of their own.
LOOKUP_SQL = """
with c as (select conv_id, turn, role, text, case when conv_id % 5 = 0 then turn * 3 - 3 else turn * 3 - 1 end as found from conversations),
called as (
  select u.*, a.found as answer,
    case u.turn % 4 when 0 then cast(json_object('limit', 'many', 'query', u.text) as varchar) when 2 then cast(json_object('limit', u.turn) as varchar)
      else cast(json_object('limit', u.turn, 'query', u.text) as varchar) end as args,
    case u.turn % 4 when 0 then '["not integer limit"]' when 2 then '["missing query"]' end as errors
  from c u left join c a on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant' where u.role = 'user'),
results as (select a.*, u.turn * 3 + 1 as asked from c a left join c u on u.conv_id = a.conv_id and u.turn = a.turn - 1 and u.role = 'user' where a.role = 'assistant')
select conv_id, turn * 3 as turn, 'message' as kind, cast(null as varchar) as call_id, 'message' as status, turn * 3 as order_turn, 0 as order_phase, 0 as order_no,
  cast(json_object('content', text, 'role', role) as varchar) as json from c
union all
select conv_id, turn * 3 + 1, 'message', null, 'message', turn * 3 + 1, 0, 0, '{"role":"assistant"}' from called
union all
select conv_id, turn * 3 + 1, 'call', 'q' || turn, case when answer is null then 'pending' else 'linked' end, turn * 3 + 1, 0, 1,
  '{"arguments":' || cast(to_json(args) as varchar) || coalesce(',"errors":' || errors, '') || ',"id":"q' || turn || '","name":"lookup"' || coalesce(',"result_turn":' || answer, '')
    || ',"valid":' || case when errors is null then 'true' else 'false' end || '}' from called
union all
select conv_id, found, 'result', 'q' || (turn - 1), case when asked is null then 'orphan' else 'linked' end, greatest(found, coalesce(asked, found)),
  case when asked >= found then 1 else 0 end, case when asked >= found then 1 else 0 end,
  '{' || coalesce('"call_turn":' || asked || ',', '') || '"content":' || cast(to_json(text) as varchar) || ',"id":"q' || (turn - 1) || '","role":"tool"}' from results
"""
