"""Chat formatting with tool calls: linking of calls and results, order by dependency, validation, canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from annograph.llm.common import heavy_keys, range_sums, salted_join, stored
from annograph.plans.skew import HOT_ROWS, split_hot

#: JSON types of a schema by the variant types they admit.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*", "null": "VOID"}


def _with_schema(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Calls with the fields of their tool; a tool that most calls name is spread over tasks."""
    fields = schemas.groupBy("name").agg(F.array_sort(F.collect_set(F.struct("field", "type", "required"))).alias("fields"))
    heavy = heavy_keys(calls.where("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("n")), ["name"], "n")
    return salted_join(calls, fields, ["name"], heavy, ["conv_id", "call_id", "turn"], "left")


def _errors() -> Column:
    """Sorted findings of a call's arguments against its tool's fields."""
    parsed = F.try_parse_json("arguments")
    keys = F.coalesce(F.json_object_keys("arguments"), F.array().cast("array<string>"))

    def kind(f: Column) -> Column:
        return F.schema_of_variant(F.variant_get(parsed, F.concat(F.lit("$['"), f["field"], F.lit("']")), "variant"))

    def matches(f: Column) -> Column:
        wanted = F.lit("")
        for name, pattern in TYPES.items():
            wanted = F.when(f["type"] == name, F.lit(f"^({pattern})$")).otherwise(wanted)
        return F.regexp_like(kind(f), wanted)

    known = F.transform("fields", lambda f: f["field"])
    missing = F.transform(F.filter("fields", lambda f: f["required"] & ~F.array_contains(keys, f["field"])), lambda f: F.concat(F.lit("missing:"), f["field"]))
    wrong = F.transform(
        F.filter("fields", lambda f: F.array_contains(keys, f["field"]) & ~F.coalesce(matches(f), F.lit(False))), lambda f: F.concat(F.lit("type:"), f["field"])
    )
    unknown = F.transform(F.array_except(keys, known), lambda k: F.concat(F.lit("unknown:"), k))
    return (
        F.when(F.col("fields").isNull(), F.array(F.lit("tool:unknown")))
        .when(parsed.isNull() | ~F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False)), F.array(F.lit("arguments:unreadable")))
        .otherwise(F.array_sort(F.concat(missing, wrong, unknown)))
    )


def order_calls(calls: DataFrame) -> DataFrame:
    """`conv_id`, `call_id`, `place`, `depth`, `cyclic` for calls with one row an id and an optional `needs`, the id of a call
    that must come before.

    `place` is the largest turn among a call and all it builds on, `depth` the length of that chain: order by (place,
    depth, turn) puts every call behind what it needs and moves nothing else. Chains are followed by doubling jumps, so
    rounds grow with the logarithm of the longest chain. A chain that does not end within the number of calls is a cycle.
    """
    known = calls.select("conv_id", F.col("call_id").alias("needs"))
    heavy = heavy_keys(calls.where("needs is not null").groupBy("conv_id", "needs").agg(F.count(F.lit(1)).alias("n")), ["conv_id", "needs"], "n")
    linked = salted_join(calls, known.withColumn("there", F.lit(True)), ["conv_id", "needs"], heavy, ["call_id"], "left")
    jump = F.when(F.col("there") & (F.col("needs") != F.col("call_id")), F.col("needs"))
    looped = F.coalesce(F.col("needs") == F.col("call_id"), F.lit(False))
    state = stored(
        linked.select("conv_id", "call_id", F.col("turn").alias("place"), F.when(jump.isNotNull(), 1).otherwise(0).cast("long").alias("depth"), jump.alias("jump"), looped.alias("cyclic")), "chains"
    )
    longest = state.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(int(longest).bit_length() + 1):
        waiting = state.where("jump is not null")
        if not waiting.take(1):
            break
        ahead = state.select("conv_id", F.col("call_id").alias("jump"), F.col("place").alias("p"), F.col("depth").alias("d"), F.col("jump").alias("j"), F.col("cyclic").alias("c"))
        heavy = heavy_keys(waiting.groupBy("conv_id", "jump").agg(F.count(F.lit(1)).alias("n")), ["conv_id", "jump"], "n")
        moved = salted_join(waiting, ahead, ["conv_id", "jump"], heavy, ["call_id"]).select(
            "conv_id", "call_id", F.greatest("place", "p").alias("place"), (F.col("depth") + F.col("d")).alias("depth"), F.col("j").alias("jump"), (F.col("cyclic") | F.col("c")).alias("cyclic")
        )
        state = stored(state.where("jump is null").unionByName(moved), "chains")
    return state.select("conv_id", "call_id", "place", "depth", (F.col("cyclic") | F.col("jump").isNotNull()).alias("cyclic"))


def _positions(rows: DataFrame, order: list[str], limit: int = HOT_ROWS) -> DataFrame:
    """`position` from 1 within a conversation. Those of over `limit` rows are range-sorted, whatever their turns are."""
    ordinary, large = split_hot(rows, ["conv_id"], limit)
    numbered = ordinary.withColumn("position", F.row_number().over(W.partitionBy("conv_id").orderBy(*order)).cast("bigint"))
    if large is None:
        return numbered
    marked = stored(large.withColumn("tie", F.monotonically_increasing_id()).withColumn("one", F.lit(1)), "large-chats")
    ranked = range_sums(marked, ["conv_id"], [*order, "tie"], {"before": "one"}, marked.count(), "chat-order")
    return numbered.unionByName(ranked.withColumn("position", F.col("before") + 1).drop("before", "tie", "one"))


def format_chats(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each message, tool call turn and tool result of every conversation, in a valid order, as canonical JSON.

    `messages`: conv_id, turn, role, text. `calls`: conv_id, turn, call_id, name, arguments (JSON text), needs (id of a
    call of the conversation, or null); a call belongs to the message of its turn. `results`: conv_id, turn, call_id,
    content. `schemas`: name, field, type (see `TYPES`), required; field names without quotes. Other columns are not
    read, so their names cannot clash.

    Returns conv_id, position (from 1), turn, role, call_id, depth, status, errors, json. Status of a call row: `linked`,
    `no_result`, `duplicate_id` (not the first of its id), `cycle` (needs itself in the end); of a tool row `linked`,
    `orphan` (no such call) or `repeated` (not the first result); of others `plain`. A result stands right behind its
    call, an orphan at its own turn. Errors list missing, wrongly typed and unknown arguments, or `tool:unknown`, or
    `arguments:unreadable` (null, no JSON object, repeated keys, or beyond Spark's variant size). JSON has sorted keys,
    no blanks and no nulls. Null texts are left out of the JSON; rows with a null conv_id form one conversation; a null
    turn counts as 0; a null call id is no call. Equal rows are kept, each with a position of its own; ties go by role,
    call id and JSON.
    """
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn")
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("\0")).alias("conv_id")
    messages = messages.select(conv, turn, "role", "text")
    calls = calls.select(conv, turn, F.col("call_id").cast("string").alias("call_id"), "name", "arguments", F.col("needs").cast("string").alias("needs")).where("call_id is not null")
    results = results.select(conv, turn, F.col("call_id").cast("string").alias("call_id"), "content")
    checked = stored(_with_schema(calls, schemas).withColumn("errors", _errors()).drop("fields"), "calls")
    # The first call of an id is the one that results and needs refer to.
    mark = F.struct("turn", F.xxhash64("name", "arguments", "needs").alias("h"))
    firsts = checked.groupBy("conv_id", "call_id").agg(F.min(mark).alias("first"), F.min_by("needs", mark).alias("needs"), F.count(F.lit(1)).alias("n"))
    firsts = stored(firsts.select("conv_id", "call_id", F.col("first.turn").alias("turn"), F.col("first.h").alias("h"), "needs", "n"), "first-calls")
    answers = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", F.xxhash64("content").alias("h"))).alias("answer"), F.count(F.lit(1)).alias("n"))
    ordered = order_calls(firsts.select("conv_id", "call_id", "turn", "needs"))
    head = firsts.select("conv_id", "call_id", F.col("turn").alias("first_turn"), F.col("h").alias("first_h")).join(ordered, ["conv_id", "call_id"])
    head = head.join(answers.select("conv_id", "call_id", "answer"), ["conv_id", "call_id"], "left")
    head = stored(head, "ordered-calls")

    keys = ["conv_id", "call_id"]
    placed = salted_join(checked, head, keys, heavy_keys(firsts, keys, "n"), ["turn", "arguments"])
    is_first = (F.col("turn") == F.col("first_turn")) & (F.xxhash64("name", "arguments", "needs") == F.col("first_h"))
    status = F.when(~is_first, "duplicate_id").when(F.col("cyclic"), "cycle").when(F.col("answer").isNull(), "no_result").otherwise("linked")
    called = placed.select(
        "conv_id", "turn", F.lit("assistant").alias("role"), "call_id", F.when(is_first, F.col("place")).otherwise(F.col("turn")).alias("place"),
        F.when(is_first, F.col("depth")).otherwise(F.lit(0)).alias("depth"), F.lit(1).alias("kind"), status.alias("status"), "errors",
        F.to_json(F.struct(F.coalesce(F.to_json(F.try_parse_json("arguments")), F.col("arguments")).alias("arguments"), F.col("call_id").alias("id"), "name", F.lit("assistant").alias("role"))).alias("json"),
    )
    linked = salted_join(results, head, keys, heavy_keys(answers, keys, "n"), ["turn", "content"], "left")
    is_answer = (F.col("turn") == F.col("answer.turn")) & (F.xxhash64("content") == F.col("answer.h"))
    none = F.array().cast("array<string>")
    returned = linked.select(
        "conv_id", "turn", F.lit("tool").alias("role"), "call_id", F.greatest(F.coalesce("place", "turn"), F.when(is_answer, F.col("place")).otherwise(F.col("turn"))).alias("place"),
        F.coalesce("depth", F.lit(0)).alias("depth"), F.lit(2).alias("kind"),
        F.when(F.col("place").isNull(), "orphan").when(is_answer, "linked").otherwise("repeated").alias("status"), none.alias("errors"),
        F.to_json(F.struct("content", F.lit("tool").alias("role"), F.col("call_id").alias("tool_call_id"))).alias("json"),
    )
    plain = messages.select(
        "conv_id", "turn", "role", F.lit(None).cast("string").alias("call_id"), F.col("turn").alias("place"), F.lit(0).cast("long").alias("depth"), F.lit(0).alias("kind"),
        F.lit("plain").alias("status"), none.alias("errors"), F.to_json(F.struct(F.col("text").alias("content"), "role")).alias("json"),
    )
    rows = stored(plain.unionByName(called).unionByName(returned), "messages")
    return _positions(rows, ["place", "depth", "kind", "turn", "role", "call_id", "json"]).select(F.when(F.col("conv_id") != "\0", F.col("conv_id")).alias("conv_id"), "position", "turn", "role", "call_id", "depth", "status", "errors", "json")
