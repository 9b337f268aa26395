"""Chat formatting: tool calls linked with their results, ordered, validated and written as canonical JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_KINDS = {"string": str, "boolean": bool, "object": dict, "array": list}


def canonical(value) -> str:
    """JSON with sorted names, no blanks, and characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def valid(value, schema: dict) -> bool:
    """Whether a value meets a schema of type, enum, properties, required, additionalProperties and items."""
    kind = schema.get("type")
    if kind in ("integer", "number"):
        if isinstance(value, bool) or not isinstance(value, int if kind == "integer" else (int, float)):
            return False
    elif kind == "null" and value is not None or kind in _KINDS and not isinstance(value, _KINDS[kind]):
        return False
    if "enum" in schema and value not in schema["enum"]:
        return False
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if any(name not in value for name in schema.get("required", ())):
            return False
        if schema.get("additionalProperties") is False and any(name not in known for name in value):
            return False
        return all(valid(value[name], rule) for name, rule in known.items() if name in value)
    if isinstance(value, list) and "items" in schema:
        return all(valid(x, schema["items"]) for x in value)
    return True


def _object(text: str):
    """The object that a text spells, or None."""
    if not text.lstrip().startswith("{"):
        return None
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _message(role: str, text: str, schemas: dict) -> tuple[str, list[dict], str | None]:
    """Canonical message, its calls and the call it answers."""
    body = _object(text) if role in ("assistant", "tool") else None
    if role == "assistant" and body is not None and isinstance(body.get("tool_calls"), list):
        calls = []
        for i, call in enumerate(c for c in body["tool_calls"] if isinstance(c, dict)):
            arguments = call.get("arguments", {})
            if isinstance(arguments, str):
                arguments = _object(arguments)
            name = str(call.get("name", ""))
            fits = name in schemas and arguments is not None and valid(arguments, schemas[name])
            calls.append({"id": None if call.get("id") is None else str(call["id"]), "at": i, "name": name, "valid": fits, "arguments": arguments})
        shown = {"content": body.get("content") or "", "role": role, "tool_calls": [{k: c[k] for k in ("arguments", "id", "name")} for c in calls]}
        return canonical(shown), calls, None
    if role == "tool" and body is not None and body.get("tool_call_id") is not None:
        return canonical({"content": body.get("content"), "role": role, "tool_call_id": str(body["tool_call_id"])}), [], str(body["tool_call_id"])
    return canonical({"content": text, "role": role}), [], None


def _parse(batches: Iterator[pa.RecordBatch], schemas: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [_message(r or "", t or "", schemas) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        calls = [[{k: c[k] for k in ("id", "at", "valid")} for c in x] for _, x, _ in done]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array([x for x, _, _ in done], pa.string()), pa.array(calls, pa.list_(pa.struct([("id", pa.string()), ("at", pa.int32()), ("valid", pa.bool_())]))), pa.array([x for _, _, x in done], pa.string())], names=["conv_id", "turn", "role", "shown", "calls", "answers"])


_CALLS = "array<struct<id:string,at:int,valid:boolean>>"


def format_chats(messages: DataFrame, schemas: dict | None = None) -> DataFrame:
    """One canonical JSON array of messages for each conversation.

    An assistant's text ``{"tool_calls": [{"id", "name", "arguments"}], "content"}`` makes calls, a tool's
    ``{"tool_call_id", "content"}`` answers one; any other text is plain content.  Calls and answers are
    hash-joined by (conv_id, id): an answer belongs to the nearest call of its id in an earlier turn, or, if there
    is none, to the first one of its turn or later.  Messages follow their turns, but an answer stands right
    behind the message of its call, by the call's place (the topological order, as answers make no calls), and
    answers of one call by their own turns.  Arguments are checked against ``schemas`` (tool name to schema);
    unknown tools are invalid.

    Null roles and texts are empty; null turns come first; messages with one turn are ordered by their JSON;
    repeated rows stay.  Calls without an id are counted, but answered by nothing, and are open.  The rows with a null conv_id
    are one conversation.  Returns conv_id, n_messages, n_calls, n_invalid, n_linked (answers with a call),
    n_orphans (without), n_open (calls without an answer) and chat.
    """
    rules = schemas or {}
    picked = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    parsed = common.stored(picked.mapInArrow(lambda it: _parse(it, rules), f"conv_id long, turn long, role string, shown string, calls {_CALLS}, answers string"))
    # a null turn comes first; spots are (turn known, turn, message, place of the call in it)
    spot = lambda *more: F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), F.col("shown"), *more)
    made = parsed.select("conv_id", F.explode("calls").alias("c"), "turn", "shown").where("c.id is not null").select("conv_id", F.col("c.id").alias("id"), spot(F.col("c.at").alias("at")).alias("spot"))
    asked = parsed.where("answers is not null").select("conv_id", F.col("answers").alias("id"), F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn")).distinct()
    calls = made.groupBy("conv_id", "id").agg(F.array_sort(F.collect_list("spot")).alias("spots"))
    earlier = F.filter("spots", lambda s: (~s["known"] & F.col("known")) | ((s["known"] == F.col("known")) & (s["turn"] < F.col("turn"))))
    linked = asked.join(calls, asked["conv_id"].eqNullSafe(calls["conv_id"]) & (asked["id"] == calls["id"])).select(asked["conv_id"], asked["id"], "known", "turn", "spots", F.coalesce(F.try_element_at(earlier, F.lit(-1)), F.get("spots", 0)).alias("called"))
    # a repeated call message is answered with its twins
    answered = common.stored(linked.select("*", F.size(F.filter("spots", lambda s: s == F.col("called"))).alias("twins")).drop("spots"))
    own = parsed.select("*", F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("number"))
    a = answered.select(F.col("conv_id").alias("call_conv"), F.col("id").alias("call_id"), F.col("known").alias("call_known"), F.col("turn").alias("call_number"), "called")
    here = own["conv_id"].eqNullSafe(a["call_conv"]) & (own["answers"] == a["call_id"]) & (own["known"] == a["call_known"]) & (own["number"] == a["call_number"])
    placed = own.join(a, here, "left")
    order = F.struct(F.coalesce("called.known", "known").alias("known"), F.coalesce("called.turn", "number").alias("turn"), F.coalesce("called.shown", "shown").alias("message"), F.col("called").isNotNull().alias("after"), F.coalesce("called.at", F.lit(0)).alias("at"), F.col("number").alias("own"), F.col("shown"))
    whole = placed.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.sum(F.size("calls")).cast("long").alias("n_calls"),
        F.sum(F.size(F.filter("calls", lambda c: ~c["valid"]))).cast("long").alias("n_invalid"),
        F.count(F.col("called")).alias("n_linked"),
        F.count(F.when(F.col("answers").isNotNull() & F.col("called").isNull(), 1)).alias("n_orphans"),
        F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda m: m["shown"]), ","), F.lit("]")).alias("chat"),
    )
    closed = answered.groupBy("conv_id", "id", "called").agg(F.max("twins").alias("twins")).groupBy("conv_id").agg(F.sum("twins").alias("n_closed"))
    joined = whole.join(closed.withColumnRenamed("conv_id", "call_conv"), whole["conv_id"].eqNullSafe(F.col("call_conv")), "left")
    return joined.select("conv_id", "n_messages", "n_calls", "n_invalid", "n_linked", "n_orphans", (F.col("n_calls") - F.coalesce("n_closed", F.lit(0))).alias("n_open"), "chat")
