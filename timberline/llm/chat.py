"""Chat formatting with linked tool calls, in DataFrame functions only.

An assistant's turn whose text is a JSON object with `tool_calls` (each: id, name, arguments, and ids that it comes
`after`) makes calls; a turn of role `tool` whose text is a JSON object with `tool_call_id` and `content` holds a
result. Calls and results are joined by (conversation, identifier). Calls are ordered topologically by `after`, level
by level; a result stands after its call, wherever its row was. Arguments are validated against the tools' schemas,
and every message is written as canonical JSON: keys sorted, no white space.

The result has one row for each message, with the columns that order it in its conversation. It isn't gathered into
one row for each conversation, since one conversation may hold any share of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timberline.sources.shared import materialise

CALLS = "content string, tool_calls array<struct<id:string,name:string,arguments:string,after:array<string>>>"
RESULT = "tool_call_id string, content string"
#: Tools by name, each with its arguments: type (string, integer, number, boolean, object, array) and if required.
SCHEMAS: dict[str, dict[str, tuple[str, bool]]] = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculate": {"expression": ("string", True)},
    "fetch": {"url": ("string", True), "headers": ("object", False)},
}
#: What schema_of_variant calls JSON types.
TYPES = {"string": "^STRING$", "integer": "^(BIGINT|DECIMAL\\(\\d+,0\\))$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$", "object": "^OBJECT", "array": "^ARRAY"}


def canonical(json: Column) -> Column:
    """A JSON text with sorted keys and no white space; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(json))


def quoted(text: Column) -> Column:
    """A JSON string, or null."""
    return F.coalesce(F.regexp_replace(F.to_json(F.struct(text.alias("x"))), r"^\{\"x\":(?s:(.*))\}$", "$1"), F.lit("null"))


def text_json(text: Column) -> Column:
    return F.when(text.isNull(), F.lit("null")).otherwise(quoted(text))


def argument_errors(name: Column, arguments: Column, schemas: dict) -> Column:
    """Sorted errors: unknown_tool, invalid_json, missing:x, type:x, unexpected:x."""
    value = F.try_parse_json(arguments)
    keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    out = F.array(F.lit("unknown_tool"))
    for tool, args in sorted(schemas.items()):
        checks = []
        for arg, (kind, required) in sorted(args.items()):
            there = F.array_contains(keys, arg)
            right = F.schema_of_variant(F.try_variant_get(value, f"$['{arg}']", "variant")).rlike(TYPES[kind])
            checks.append(F.when(~there, F.lit(f"missing:{arg}") if required else F.lit(None)).when(~F.coalesce(right, F.lit(False)), F.lit(f"type:{arg}")))
        known = F.array(*[F.lit(a) for a in sorted(args)]).cast("array<string>")
        found = F.concat(F.array_compact(F.array(*checks).cast("array<string>")), F.transform(F.array_except(keys, known), lambda k: F.concat(F.lit("unexpected:"), k)))
        out = F.when(name == tool, found).otherwise(out)
    bad = value.isNull() | ~F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    return F.array_sort(F.when(bad, F.array(F.lit("invalid_json"))).otherwise(out))


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, id and level of every call: 0 without a call to come after, else one more than the highest of these.
    Calls in a cycle, or after one, have level null. Ids that no call has are no constraint."""
    nodes = calls.select("conv_id", "id").distinct()
    edges = calls.select("conv_id", "id", F.explode("after").alias("dep")).distinct()
    edges = materialise(edges.join(nodes.select("conv_id", F.col("id").alias("dep")), ["conv_id", "dep"], "left_semi"), "dependencies")
    if edges.isEmpty():
        return nodes.withColumn("level", F.lit(0))
    done = materialise(nodes.join(edges, ["conv_id", "id"], "left_anti").withColumn("level", F.lit(0)), "levels")
    while True:
        wait = edges.join(done.select("conv_id", "id"), ["conv_id", "id"], "left_anti")
        on = done.select("conv_id", F.col("id").alias("dep"), "level")
        ready = wait.join(on, ["conv_id", "dep"], "left").groupBy("conv_id", "id").agg(F.max("level").alias("top"), F.sum(F.col("level").isNull().cast("int")).alias("open"))
        ready = materialise(ready.where("open = 0").select("conv_id", "id", (F.col("top") + 1).alias("level")), "ready")
        if ready.isEmpty():
            return nodes.join(done, ["conv_id", "id"], "left")
        done = materialise(done.unionByName(ready), "levels")


def format_chats(conversations: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """One row for each message: conv_id, turn (its row's), at_turn, at_kind, at_level, at_place (which order the
    messages of a conversation), role, message (canonical JSON), errors (sorted, joined by blanks; empty: none).

    at_turn is the turn it belongs to: a linked result's is its call's turn. at_kind: 0 a message, 1 a linked result,
    2 a result without a call (error orphan_result). Calls in a message are written by (level, place). A call's errors,
    each with its id in front: those of its arguments, duplicate_id (an id that an earlier call of the conversation
    has; results belong to the first), no_result, cycle. Of several results of one id all are linked, those after the
    first with the error repeated_result.

    A null text is the content null, a null role is written as null, null ids and turns stay. Text that isn't such JSON
    is content, however long. Repeated rows stay: their calls have duplicate_id, their results repeated_result. An empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    text, role = F.col("text").cast("string"), F.col("role").cast("string")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"))
    is_json = F.ltrim("text").startswith("{")
    c = F.when((F.col("role") == "assistant") & is_json, F.from_json("text", CALLS))
    r = F.when((F.col("role") == "tool") & is_json, F.from_json("text", RESULT))
    rows = rows.withColumn("c", c).withColumn("r", r)
    calling, result = F.coalesce(F.size("c.tool_calls") > 0, F.lit(False)), F.col("r.tool_call_id").isNotNull()
    zero = F.lit(0)
    cols = ["conv_id", "turn", "at_turn", "at_kind", "at_level", "at_place", "role", "message", "errors"]

    plain = rows.where(~calling & ~F.coalesce(result, F.lit(False)))
    message = F.concat(F.lit('{"content":'), text_json(F.col("text")), F.lit(',"role":'), text_json(F.col("role")), F.lit("}"))
    plain = plain.select("conv_id", "turn", F.col("turn").alias("at_turn"), zero.alias("at_kind"), zero.alias("at_level"), zero.alias("at_place"), "role", message.alias("message"), F.lit("").alias("errors"))

    # what holds calls and results is written once: it is read several times and is a small part of the table
    tools = materialise(rows.where(calling | result).withColumn("row", F.monotonically_increasing_id()), "tools")
    calls = tools.where("c IS NOT NULL").select("conv_id", "turn", "row", F.col("c.content").alias("content"), F.posexplode("c.tool_calls").alias("place", "call"))
    calls = calls.select("conv_id", "turn", "row", "content", "place", "call.id", "call.name", "call.arguments", F.coalesce("call.after", F.array().cast("array<string>")).alias("after"))
    first = calls.where("id IS NOT NULL").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "row", "place")).alias("first"))
    results = tools.where("r IS NOT NULL").select("conv_id", "turn", "row", F.col("r.tool_call_id").alias("id"), F.col("r.content").alias("content"))
    answered = results.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "row")).alias("answer"))
    level = levels(calls.where("id IS NOT NULL"))
    known = first.join(answered, ["conv_id", "id"], "left").join(level, ["conv_id", "id"], "left")
    same = lambda k: F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("id") == F.col("_id"))
    known = known.select(F.col("conv_id").alias("_conv"), F.col("id").alias("_id"), "first", "answer", "level")
    linked = calls.join(known, same(0), "left")
    errors = F.concat(
        argument_errors(F.col("name"), F.col("arguments"), schemas),
        F.when(F.col("id").isNull(), F.array(F.lit("no_id"))).when(F.struct("turn", "row", "place") != F.col("first"), F.array(F.lit("duplicate_id"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("answer").isNull(), F.array(F.lit("no_result"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("id").isNotNull() & F.col("level").isNull(), F.array(F.lit("cycle"))).otherwise(F.array().cast("array<string>")),
    )
    arguments = F.coalesce(canonical(F.col("arguments")), text_json(F.col("arguments")))
    call = F.concat(F.lit('{"arguments":'), arguments, F.lit(',"id":'), text_json(F.col("id")), F.lit(',"name":'), text_json(F.col("name")), F.lit("}"))
    said = F.transform(F.array_sort(errors), lambda e: F.concat(F.coalesce("id", F.lit("")), F.lit("="), e))
    # one message's calls come from one text
    one = linked.select("conv_id", "turn", "row", "content", F.struct(F.coalesce("level", F.lit(2147483647)).alias("level"), "place", call.alias("call"), said.alias("errors")).alias("x"))
    one = one.groupBy("conv_id", "turn", "row", "content").agg(F.array_sort(F.collect_list("x")).alias("x"))
    message = F.concat(F.lit('{"content":'), text_json(F.col("content")), F.lit(',"role":"assistant","tool_calls":['), F.array_join("x.call", ","), F.lit("]}"))
    made = one.select("conv_id", "turn", F.col("turn").alias("at_turn"), zero.alias("at_kind"), zero.alias("at_level"), zero.alias("at_place"), F.lit("assistant").alias("role"), message.alias("message"), F.array_join(F.flatten("x.errors"), " ").alias("errors"))

    joined = results.join(known, same(0), "left")
    message = F.concat(F.lit('{"content":'), text_json(F.col("content")), F.lit(',"role":"tool","tool_call_id":'), text_json(F.col("id")), F.lit("}"))
    orphan = F.col("first").isNull()
    errors = F.when(orphan, "orphan_result").when(F.struct("turn", "row") != F.col("answer"), "repeated_result").otherwise("")
    got = joined.select("conv_id", "turn", F.coalesce("first.turn", "turn").alias("at_turn"), F.when(orphan, 2).otherwise(1).alias("at_kind"), F.coalesce("level", zero).alias("at_level"), F.coalesce("first.place", zero).alias("at_place"), F.lit("tool").alias("role"), message.alias("message"), errors.alias("errors"))
    return plain.select(cols).unionByName(made.select(cols)).unionByName(got.select(cols))


def with_tools(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text in which assistants call tools and get results, derived from conversations without
    tools, so that linking meets data of any size.

    An assistant's turn t makes the call c<t>, of a tool and with arguments by t modulo 4 (right, of a wrong type,
    unexpected, an unknown tool), to come after c<t-2> but at every fifth turn; the turn after it is the result of
    c<t-1> unless t is divisible by 3 or an assistant's (an orphan, where t-1 makes no call). Texts stay, as contents;
    null texts, repeated rows and other roles too. A null turn is left as it is.
    """
    t, n = F.col("turn"), F.col("turn").cast("string")
    text = text_json(F.col("text").cast("string"))
    call = F.when(t % 4 == 0, F.concat(F.lit('"name": "search", "arguments": {"query": "q'), n, F.lit('", "limit": '), n, F.lit("}")))
    call = call.when(t % 4 == 1, F.concat(F.lit('"name": "calculate", "arguments": {"expression": '), n, F.lit("}")))
    call = call.when(t % 4 == 2, F.concat(F.lit('"name": "fetch", "arguments": {"x": 1, "url": "u'), n, F.lit('"}'))).otherwise(F.lit('"name": "nope", "arguments": {"a": [ ]}'))
    after = F.when(t % 5 == 0, F.lit("")).otherwise(F.concat(F.lit('"c'), (t - 2).cast("string"), F.lit('"')))
    calls = F.concat(F.lit('{"content": '), text, F.lit(', "tool_calls": [{"id": "c'), n, F.lit('", '), call, F.lit(', "after": ['), after, F.lit("]}]}"))
    result = F.concat(F.lit('{"tool_call_id": "c'), (t - 1).cast("string"), F.lit('", "content": '), text, F.lit("}"))
    answers = (F.col("role") == "user") & (t > 0) & (t % 3 != 0)
    return conversations.select(
        F.col("conv_id"), t, F.when(answers, "tool").otherwise(F.col("role")).alias("role"),
        F.when((F.col("role") == "assistant") & t.isNotNull(), calls).when(answers, result).otherwise(F.col("text")).alias("text"),
    )


#: format_chats(with_tools()) in DuckDB SQL.
TOOLS_SQL = """
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(to_json(text)::VARCHAR, 'null') AS content, coalesce(to_json(role)::VARCHAR, 'null') AS said,
    coalesce(role = 'assistant', FALSE) AS calls, coalesce(role = 'user' AND turn > 0 AND turn % 3 <> 0, FALSE) AS answers FROM conversations),
c AS (SELECT conv_id, turn, CASE WHEN turn % 5 <> 0 THEN turn - 2 END AS dep FROM m WHERE calls),
v AS (SELECT conv_id, turn, 0 AS level FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.conv_id = c.conv_id AND d.turn = c.dep)
    UNION ALL SELECT c.conv_id, c.turn, v.level + 1 FROM c JOIN v ON c.conv_id = v.conv_id AND c.dep = v.turn),
a AS (SELECT conv_id, turn - 1 AS turn FROM m WHERE answers),
e AS (SELECT m.*, CASE turn % 4 WHEN 0 THEN [] WHEN 1 THEN ['type:expression'] WHEN 2 THEN ['unexpected:x'] ELSE ['unknown_tool'] END
    || CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.conv_id = m.conv_id AND a.turn = m.turn) THEN [] ELSE ['no_result'] END AS errors,
    CASE turn % 4 WHEN 0 THEN '{"limit":' || turn || ',"query":"q' || turn || '"}' WHEN 1 THEN '{"expression":' || turn || '}' WHEN 2 THEN '{"url":"u' || turn || '","x":1}' ELSE '{"a":[]}' END AS arguments,
    CASE turn % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'calculate' WHEN 2 THEN 'fetch' ELSE 'nope' END AS name FROM m WHERE calls)
SELECT conv_id, turn, turn AS at_turn, 0 AS at_kind, 0 AS at_level, 0 AS at_place, role, '{"content":' || content || ',"role":' || said || '}' AS message, '' AS errors FROM m WHERE NOT calls AND NOT answers
UNION ALL SELECT conv_id, turn, turn, 0, 0, 0, role, '{"content":' || content || ',"role":"assistant","tool_calls":[{"arguments":' || arguments || ',"id":"c' || turn || '","name":"' || name || '"}]}',
    array_to_string(list_transform(list_sort(errors), lambda x: 'c' || turn || '=' || x), ' ') FROM e
UNION ALL SELECT m.conv_id, m.turn, CASE WHEN v.turn IS NULL THEN m.turn ELSE v.turn END, CASE WHEN v.turn IS NULL THEN 2 ELSE 1 END, coalesce(v.level, 0), 0, 'tool',
    '{"content":' || content || ',"role":"tool","tool_call_id":"c' || (m.turn - 1) || '"}', CASE WHEN v.turn IS NULL THEN 'orphan_result' ELSE '' END
    FROM m LEFT JOIN v ON v.conv_id = m.conv_id AND v.turn = m.turn - 1 WHERE answers
"""

#: format_chats() in DuckDB SQL where no turn makes or answers calls, as in the given tables.
ORACLE_SQL = """
SELECT conv_id, turn, turn AS at_turn, 0 AS at_kind, 0 AS at_level, 0 AS at_place, role,
    '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}' AS message, '' AS errors
FROM conversations
"""
