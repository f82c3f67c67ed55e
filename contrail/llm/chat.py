"""Chat formatting with tool calls: link, order, validate, serialise.  DataFrame operations only.

* Results are joined to calls by conversation and call id.  An id that several calls have belongs to the first
  of them (by turn, name, arguments, dependency); results link to that one and never to each other.
* Calls may name a call whose result they use.  A call's level is two times the number of calls before it in
  that chain, its results' level is one more, so ordering by level is a topological order.  Levels come from
  doubling jumps along the chain; calls in or behind a cycle have none.
* Arguments are checked against the tool's schema: JSON object, required and known names, types.
* Lines are canonical JSON: keys sorted at every depth, no white space, null where a value is missing.

Nothing is gathered by conversation, so one that holds a third of all rows is as good as any other.  Rows with
null ids link to nothing; null texts are null; repeated rows come out as often as they went in; empty tables
give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import materialise

# A schema: tool -> argument -> (JSON type, required).  Types: string, integer, number, boolean, array, object.
Schemas = dict[str, dict[str, tuple[str, bool]]]
_TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$",
          "array": "^ARRAY<.*", "object": "^OBJECT<.*"}


def quoted(value: Column) -> Column:
    """A string as a JSON literal."""
    literal = F.to_json(F.struct(value.cast("string").alias("v")), {"ignoreNullFields": "false"})
    return F.substring(literal, F.lit(6), F.length(literal) - 6)


def canonical(arguments: Column) -> Column:
    """JSON with sorted keys; the literal null where the text is not JSON."""
    return F.coalesce(F.to_json(F.try_parse_json(arguments)), F.lit("null"))


def problems(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with a call's arguments, in the order of the alphabet; empty if nothing is."""
    value = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    by_tool = F.lit("unknown_tool")
    for tool, arg in schemas.items():
        found = [F.concat(F.lit("unknown:"), F.array_join(F.array_sort(F.array_except(keys, F.array(*map(F.lit, arg)))), ","))]
        found = [F.when(F.size(F.array_except(keys, F.array(*map(F.lit, arg)))) > 0, found[0])]
        for key, (kind, required) in arg.items():
            given = F.schema_of_variant(F.try_variant_get(value, f"$.{key}", "variant"))
            there = F.array_contains(keys, key)
            found.append(F.when(there & ~F.coalesce(given.rlike(_TYPES[kind]), F.lit(False)), F.lit(f"type:{key}")))
            if required:
                found.append(F.when(~there, F.lit(f"missing:{key}")))
        by_tool = F.when(name == tool, F.array_join(F.array_sort(F.array_compact(F.array(*found))), " ")).otherwise(by_tool)
    return F.when(value.isNull() | keys.isNull(), F.lit("not_an_object")).otherwise(by_tool)


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level of distinct calls (conv_id, call_id, after); null in or behind a cycle."""
    known = calls.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("there"))
    jumps = calls.join(known, ["conv_id", "after"], "left").select(
        "conv_id", "call_id", F.when(F.col("there"), F.col("after")).alias("up"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("steps"))
    jumps = materialise(jumps, "chat-levels")
    longest = jumps.count()
    reach = 1
    while reach <= 2 * longest and jumps.where("up IS NOT NULL").limit(1).count():
        upper = jumps.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("over"), F.col("steps").alias("more"))
        joined = jumps.join(upper, ["conv_id", "up"], "left")
        jumps = materialise(joined.select("conv_id", "call_id", F.col("over").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "chat-levels")
        reach *= 2
    return jumps.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("steps") * 2).alias("level"))


def format_chat(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """conv_id, turn, kind, call_id, level, status, problems, line: a row for every message, call and result.

    ``messages``: conv_id, turn, role, text; ``calls``: conv_id, turn, call_id, name, arguments, after;
    ``results``: conv_id, turn, call_id, content.
    """
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments", "after")
    results = results.select("conv_id", "turn", "call_id", "content")
    first = F.min(F.struct("turn", "name", "arguments", "after")).alias("first")
    owners = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(first)
    owners = materialise(owners, "chat-owners")
    level = levels(owners.select("conv_id", "call_id", F.col("first.after").alias("after")))
    answered = results.where("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.count("*").alias("n_results"))
    linked = owners.join(level, ["conv_id", "call_id"]).join(answered, ["conv_id", "call_id"], "left")
    linked = materialise(linked, "chat-linked")
    this = F.struct("turn", "name", "arguments", "after")
    call_rows = calls.join(linked.hint("merge"), ["conv_id", "call_id"], "left").select(
        "conv_id", "turn", F.lit("call").alias("kind"), "call_id", "level",
        F.when(F.col("first").isNull(), "no_id").when(~F.col("first").eqNullSafe(this), "duplicate_id")
        .when(F.col("level").isNull(), "cycle").when(F.col("n_results").isNull(), "unanswered").otherwise("ok").alias("status"),
        problems(F.col("name"), F.col("arguments"), schemas).alias("problems"),
        F.concat(F.lit('{"arguments":'), canonical(F.col("arguments")), F.lit(',"id":'), quoted(F.col("call_id")),
                 F.lit(',"name":'), quoted(F.col("name")), F.lit("}")).alias("line"))
    result_rows = results.join(linked.hint("merge"), ["conv_id", "call_id"], "left").select(
        "conv_id", "turn", F.lit("result").alias("kind"), "call_id", (F.col("level") + 1).alias("level"),
        F.when(F.col("first").isNull(), "orphan").when(F.col("turn") < F.col("first.turn"), "before_call")
        .when(F.col("level").isNull(), "cycle").otherwise("ok").alias("status"),
        F.lit("").alias("problems"),
        F.concat(F.lit('{"call_id":'), quoted(F.col("call_id")), F.lit(',"content":'), quoted(F.col("content")), F.lit("}")).alias("line"))
    message_rows = messages.select(
        "conv_id", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("long").alias("level"),
        F.lit("ok").alias("status"), F.lit("").alias("problems"),
        F.concat(F.lit('{"content":'), quoted(F.col("text")), F.lit(',"role":'), quoted(F.col("role")), F.lit("}")).alias("line"))
    return message_rows.unionByName(call_rows).unionByName(result_rows)
