"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

An assistant's text may be a JSON object {"content", "tool_calls": [{"id", "name", "arguments"}]}, its calls also of the
form {"id", "type", "function": {"name", "arguments"}}; a tool's may be {"tool_call_id", "content"}; a system's may have
"tools", [{"name", "parameters"}] or [{"function": {"name", "parameters"}}], whose parameters are a JSON schema's "properties" and
"required". Any other text is plain content. Calls and results are hash-joined on conversation and identifier. A result stands after
its call: its place is the later of the two turns, and at one turn calls go first. Arguments, an object, are checked
against the schema that the conversation's system messages give for the called tool, or else the one passed in: required names are there,
names are known, and values have the type given. Each message is one line of canonical JSON: keys in order, no white
space, absent parts left out. Members that are not known stay, in canonical form.

Only DataFrame operations are used, and no conversation is collected: a message is a row, ordered by
(conv_id, place, rank, turn, content). Defined cases: null role or text are written as empty
strings; what is not one JSON object from end to end, has a repeated key, another role than its message's, or calls that are no
objects is plain content, kept as it is; calls without any member count for nothing; a result without a call, or a call without a result, is
kept and marked; of several results for one call each is linked; a call identifier used twice
in a conversation links at its first turn only; a call without an identifier is kept, linked with nothing; a tool
described several times has all the parameters given; a null conversation is one of its own; repeated rows stay, each with its own calls.
Extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ENTRY = "struct<key: string, json: string>"
CALL = f"struct<id: string, name: string, arguments: string, more: array<{ENTRY}>>"
TOOLS = "name string, parameter string, type string, required boolean"


def no_tools(spark: SparkSession) -> DataFrame:
    """An empty table of tool schemas: (name, parameter, type, required), a row per parameter."""
    return spark.createDataFrame([], TOOLS)


def _object(text: Column) -> Column:
    """The text as a variant, if it is one JSON object from end to end: it stands alone in an array, and as the value of a member."""
    alone = F.size(F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")) == 1
    member = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}"))).isNotNull()
    return F.when(F.ltrim(text).startswith("{") & alone & member, F.try_parse_json(text))


def _entries(v: Column) -> Column:
    """Members of an object by key, with their canonical JSON; null for anything else."""
    return F.array_sort(F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("json"))))


def _without(entries: Column, *keys: str) -> Column:
    return F.filter(entries, lambda e: ~e["key"].isin(*keys))


def _text(v: Column, path: str) -> Column:
    """A member as a string: that of a string, the canonical JSON of anything else, null of null."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(v, path, "string")).when(F.schema_of_variant(at) != "VOID", F.to_json(at))


def _quoted(x: Column) -> Column:
    """A JSON string."""
    inside = F.to_json(F.array(x))
    return inside.substr(F.lit(2), F.length(inside) - 2)


def _joined(entries: Column) -> Column:
    """An object of members, in the order of their keys."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["json"])), ","), F.lit("}"))


def _member(key: str, json: Column) -> Column:
    """A member as an array, empty where it is null."""
    return F.when(json.isNotNull(), F.array(F.struct(F.lit(key).alias("key"), json.alias("json")))).otherwise(F.array().cast(f"array<{ENTRY}>"))


def _call(c: Column) -> Column:
    """One call: its parts, wherever they stand, and what else it has."""
    nested = F.coalesce(_text(c, "$.name").isNull() & _text(c, "$.arguments").isNull() & _entries(F.try_variant_get(c, "$.function", "variant")).isNotNull(), F.lit(False))
    rest = _without(_entries(F.try_variant_get(c, "$.function", "variant")), "name", "arguments")
    own = F.when(nested, F.concat(_without(_entries(c), "id", "name", "arguments", "function"), _member("function", F.when(F.size(rest) > 0, _joined(rest))))).otherwise(_without(_entries(c), "id", "name", "arguments"))
    return F.struct(_text(c, "$.id").alias("id"), F.when(nested, _text(c, "$.function.name")).otherwise(_text(c, "$.name")).alias("name"), F.when(nested, _text(c, "$.function.arguments")).otherwise(_text(c, "$.arguments")).alias("arguments"), own.alias("more"))


def parse(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with content as JSON, calls, the identifier that a result answers, other members, and the tools that a system message describes."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), r.alias("role"), t.alias("text"), F.when(r.isin("assistant", "tool", "system"), _object(t)).alias("v"))
    rows = rows.withColumn("v", F.when(F.coalesce(_text(F.col("v"), "$.role"), F.col("role")) == F.col("role"), F.col("v")))
    listed = F.try_variant_get("v", "$.tool_calls", "array<variant>")
    objects = F.forall(listed, lambda c: F.schema_of_variant(c).startswith("OBJECT"))
    calls = F.when((F.col("role") == "assistant") & objects, F.filter(F.transform(listed, _call), lambda c: c["id"].isNotNull() | c["name"].isNotNull() | c["arguments"].isNotNull() | (F.size(c["more"]) > 0)))
    rows = rows.withColumn("calls", F.coalesce(calls, F.array().cast(f"array<{CALL}>"))).withColumn("answers", F.when(F.col("role") == "tool", _text(F.col("v"), "$.tool_call_id")))
    parsed = (F.size("calls") > 0) | F.col("answers").isNotNull()
    given = F.try_variant_get("v", "$.content", "variant")
    content = F.when(parsed, F.when(F.coalesce(F.schema_of_variant(given), F.lit("VOID")) != "VOID", F.to_json(given)).otherwise(F.lit('""'))).otherwise(_quoted(F.col("text")))
    known = F.when(F.col("role") == "tool", _without(_entries(F.col("v")), "role", "content", "tool_call_id")).otherwise(_without(_entries(F.col("v")), "role", "content", "tool_calls"))
    more = F.when(parsed, known).otherwise(F.array().cast(f"array<{ENTRY}>"))
    described = F.when(F.col("role") == "system", F.try_variant_get("v", "$.tools", "array<variant>"))
    return rows.select("conv_id", "turn", "role", content.alias("content"), "calls", "answers", more.alias("more"), described.alias("tools"))


def described(parsed: DataFrame) -> DataFrame:
    """(conv_id, name, parameter, type, required) of the tools that system messages describe; a tool without parameters has one row, of a null one."""
    one = parsed.select("conv_id", F.explode("tools").alias("t"))
    part = lambda p: F.coalesce(F.try_variant_get("t", f"$.{p}", "variant"), F.try_variant_get("t", f"$.function.{p}", "variant"))
    named = one.select("conv_id", F.coalesce(_text(F.col("t"), "$.name"), _text(F.col("t"), "$.function.name")).alias("name"), part("parameters").alias("p")).filter("name is not null")
    listed = named.select("conv_id", "name", F.explode_outer(F.map_entries(F.try_variant_get("p", "$.properties", "map<string,variant>"))).alias("e"), F.try_variant_get("p", "$.required", "array<string>").alias("r"))
    return listed.select("conv_id", "name", F.col("e.key").alias("parameter"), F.try_variant_get("e.value", "$.type", "string").alias("type"), F.coalesce(F.array_contains("r", F.col("e.key")), F.lit(False)).alias("required"))


def _is_type(value: Column, kind: Column) -> Column:
    """Whether a JSON value, as text, has a schema's type."""
    number = value.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$")
    return (
        F.when(kind == "string", value.startswith('"')).when(kind == "integer", value.rlike(r"^-?(0|[1-9]\d*)$")).when(kind == "number", number)
        .when(kind == "boolean", value.isin("true", "false")).when(kind == "array", value.startswith("[")).when(kind == "object", value.startswith("{")).when(kind == "null", value == "null").otherwise(F.lit(True))
    )


def _schema() -> Column:
    return F.collect_set(F.struct("parameter", "type", F.coalesce("required", F.lit(False)).alias("required")))


def validated(parsed: DataFrame, tools: DataFrame, own: DataFrame) -> DataFrame:
    """(key, conv_id, turn, slot, id, name, arguments, more, valid): each call, its arguments in canonical form, and whether they fit the schema."""
    calls = parsed.select("key", "conv_id", "turn", F.posexplode("calls").alias("slot", "c")).select("key", "conv_id", "turn", "slot", "c.id", "c.name", F.coalesce("c.arguments", F.lit("{}")).alias("raw"), "c.more")
    given = calls.withColumn("values", _entries(_object(F.col("raw"))))
    mine = own.groupBy(F.col("conv_id").alias("of"), F.col("name").alias("tool")).agg(_schema().alias("mine"))
    joined = given.join(tools.groupBy("name").agg(_schema().alias("general")), "name", "left").join(mine, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("name") == F.col("tool")), "left").withColumn("schema", F.coalesce("mine", "general"))
    names = F.transform("values", lambda x: x["key"])
    fits = F.forall("schema", lambda p: ~p["required"] | p["parameter"].isNull() | F.array_contains(names, p["parameter"])) & F.forall("values", lambda x: F.exists("schema", lambda p: (p["parameter"] == x["key"]) & _is_type(x["json"], p["type"])))
    return joined.select("key", "conv_id", "turn", "slot", "id", "name", F.coalesce(_joined(F.col("values")), F.col("raw")).alias("arguments"), "more", (F.col("values").isNotNull() & F.col("schema").isNotNull() & F.coalesce(fits, F.lit(False))).alias("valid"))


def _line(role: Column, content: Column, answers: Column, calls: Column, more: Column) -> Column:
    """A message as canonical JSON; ``content`` and ``calls`` are JSON already."""
    return _joined(F.concat(_member("content", content), _member("role", _quoted(role)), _member("tool_call_id", F.when(answers.isNotNull(), _quoted(answers))), _member("tool_calls", calls), more))


def _call_line(c: Column) -> Column:
    return _joined(F.concat(_member("arguments", _quoted(c["arguments"])), _member("id", F.when(c["id"].isNotNull(), _quoted(c["id"]))), _member("name", F.when(c["name"].isNotNull(), _quoted(c["name"]))), c["more"]))


def format(messages: DataFrame, tools: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: its place, links, validity and canonical JSON."""
    parsed = parse(messages, conv, turn, role, text)
    # A message's key is a digest of all that decides its outcome: repeated rows share it, so their calls are judged once and given to each.
    asked = parsed.filter(F.size("calls") > 0).withColumn("key", F.sha2(F.to_json(F.struct("conv_id", "turn", "content", "calls", "more"), {"ignoreNullFields": "false"}), 256))
    calls = validated(asked.dropDuplicates(["key"]), tools if tools is not None else no_tools(messages.sparkSession), described(parsed))
    first = calls.filter("id is not null").groupBy(F.col("conv_id").alias("of"), F.col("id").alias("call")).agg(F.min("turn").alias("called"))
    results = parsed.filter("answers is not null").join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("answers") == F.col("call")), "left")
    answered = results.filter("call is not null").select("of", "call", "called").distinct().withColumn("linked", F.lit(True))
    # Of one message's calls, all are in one row again: a message is the unit that was split.
    shape = F.sort_array(F.collect_list(F.struct("slot", F.struct("arguments", "id", "name", "more", "valid").alias("c"), F.coalesce("linked", F.lit(False)).alias("linked"))))
    per = calls.join(answered, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("id") == F.col("call")) & F.col("turn").eqNullSafe(F.col("called")), "left").groupBy("key").agg(shape.alias("s"))
    done = asked.join(per, "key", "left").select("conv_id", "turn", "role", "content", F.lit(None).cast("string").alias("answers"), "more", F.concat(F.lit("["), F.array_join(F.transform("s", lambda x: _call_line(x["c"])), ","), F.lit("]")).alias("calls"), F.size("s").alias("n_calls"), F.size(F.filter("s", lambda x: x["linked"])).alias("n_linked"), F.size(F.filter("s", lambda x: ~x["c"]["valid"])).alias("n_invalid"), F.col("turn").alias("place"), F.lit(0).alias("rank"))
    none = F.lit(None).cast("string")
    rest = lambda df, place, rank, linked: df.select("conv_id", "turn", "role", "content", "answers", "more", none.alias("calls"), F.lit(0).alias("n_calls"), linked.alias("n_linked"), F.lit(0).alias("n_invalid"), place.alias("place"), F.lit(rank).alias("rank"))
    plain = rest(parsed.filter("answers is null and size(calls) = 0"), F.col("turn"), 0, F.lit(0))
    late = rest(results, F.greatest("turn", F.coalesce("called", "turn")), 1, F.col("call").isNotNull().cast("int"))
    return plain.unionByName(late).unionByName(done).select("conv_id", "turn", "place", "rank", "role", "n_calls", "n_linked", "n_invalid", _line(*map(F.col, ("role", "content", "answers", "calls", "more"))).alias("message"))
