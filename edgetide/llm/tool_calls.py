"""Chat formatting by tool-call linking (operator 5).

Events are calls and results of tools within conversations. Calls and results meet in a hash join on (conversation,
identifier), calls are ordered by what they come after, their arguments are validated against the tool's schema, and
every event is serialised as canonical JSON (sorted keys, no blanks, UTF-8 as it is). With ``whole=True`` turns that make
no call or result are events of kind ``message``, which have a line and a status, but no place in the order.

Everything is a row per event: no conversation is ever gathered in one place, so one that holds a third of all turns
is dealt like the rest. A call names at most one call it comes after, so the order is a forest; depths are found by
pointer doubling in log2(longest chain) joins. Calls on a cycle, or behind one, never reach a root and are reported.

Status of an event, the first that applies:

================= ====================================================================================
malformed         a call or result without identifier, or whose arguments are no JSON object; a message of an
                  assistant that is broken JSON or whose calls cannot be read
duplicate         not the first event of its kind with its identifier, by (turn, position)
cycle             a call that comes after itself over any number of calls, and its result
orphan            a result without call, or a call that comes after one that does not exist
invalid           arguments that the schema of the tool does not allow, or a tool without schema
unanswered        a call without result
early             a result that stands before its call
ok                all else
================= ====================================================================================

JSON texts that hold NaN, infinite numbers, half a surrogate pair or deeper nesting than Python follows count as broken.

Defined results: texts of any length are read whole; null texts, roles and turns make no call or result, and a message with ``whole=True``; a null conv_id is a conversation of
its own; repeated rows are duplicates of each other; empty tables give empty tables.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.llm.common import Scratch

EVENT = ["conv_id", "turn", "position", "kind", "call_id", "tool", "body", "after"]
MESSAGE_SCHEMA = "conv_id long, turn long, position int, kind string, call_id string, tool string, body string, after string"
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def load(text: str):
    """The value of a JSON text; ValueError for what has no canonical form either: NaN, infinite numbers, halves of
    surrogate pairs, and lists nested deeper than Python follows."""
    try:
        value = json.loads(text)
        canonical(value).encode()
    except RecursionError:
        raise ValueError("nested too deeply") from None
    return value


def violations(value, schema: dict, path: str = "$") -> list[str]:
    """What of a JSON schema a value breaks. Known words: type, enum, required, properties, additionalProperties,
    items, minLength, maxLength, minimum, maximum."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(isinstance(value, TYPES[k]) and (k == "boolean" or not isinstance(value, bool)) for k in kinds):
        return [f"{path}: not {' or '.join(kinds)}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{path}: not one of the values allowed")
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        found.append(f"{path}: length")
    if isinstance(value, (int, float)) and not isinstance(value, bool) and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        found.append(f"{path}: out of range")
    if isinstance(value, list) and "items" in schema:
        found += [x for i, item in enumerate(value) for x in violations(item, schema["items"], f"{path}[{i}]")]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        found += [f"{path}.{k}: unknown" for k in sorted(value) if k not in known and schema.get("additionalProperties", True) is False]
        found += [x for k in sorted(value) if k in known for x in violations(value[k], known[k], f"{path}.{k}")]
    return found


def message_events(messages: DataFrame, whole: bool = False) -> DataFrame:
    """Events of messages (conv_id, turn, role, text) whose texts are JSON.

    An assistant message holds {"tool_calls": [{"id", "name", "arguments", "after"}, ...]}, a tool message
    {"tool_call_id", "content"}; other texts are no events, or with ``whole`` events of kind ``message``.
    """
    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [event for row in batch.to_pylist() for event in _message(row, whole)]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    said = F.coalesce(F.col("role").isin("assistant", "tool") & F.col("turn").isNotNull() & F.ltrim("text").startswith("{"), F.lit(False))
    found = messages.filter(said).select("conv_id", "turn", "role", "text").mapInArrow(events, MESSAGE_SCHEMA)
    return found.unionByName(_plain(messages.filter(~said))) if whole else found


def _plain(turns: DataFrame) -> DataFrame:
    """Turns as events of kind ``message``: their role stands in ``tool``, their text in ``body``."""
    none = F.lit(None).cast("string")
    return turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.lit(0).alias("position"), F.lit("message").alias("kind"),
        none.alias("call_id"), F.col("role").alias("tool"), F.col("text").alias("body"), none.alias("after"))


_ARROW = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("position", pa.int32()), ("kind", pa.string()),
                    ("call_id", pa.string()), ("tool", pa.string()), ("body", pa.string()), ("after", pa.string())])


def _message(row: dict, whole: bool) -> list[dict]:
    base = {"conv_id": row["conv_id"], "turn": row["turn"]}
    plain = {"kind": "message", "call_id": None, "tool": row["role"], "body": row["text"], "after": None}
    try:
        said = load(row["text"])
    except ValueError:
        return [base | {"position": 0} | plain] if whole else []
    if row["role"] == "tool" and "tool_call_id" in said:
        return [base | {"position": 0, "kind": "result", "call_id": _text(said["tool_call_id"]), "tool": None,
                        "body": canonical(said.get("content")), "after": None}]
    calls = said.get("tool_calls") if row["role"] == "assistant" else None
    found = [base | {"position": i} | ({
        "kind": "call", "call_id": _text(c.get("id")), "tool": _text(c.get("name")),
        "body": c["arguments"] if isinstance(c.get("arguments"), str) else canonical(c.get("arguments")),
        "after": _text(c.get("after"))} if isinstance(c, dict) else plain)
        for i, c in enumerate(calls if isinstance(calls, list) else []) if whole or isinstance(c, dict)]
    return found or ([base | {"position": 0} | plain] if whole else [])


def _broken(role: str | None, text: str | None) -> bool:
    """Whether a message should have been calls or a result: it is of a tool, or broken JSON, or holds unreadable calls."""
    if role != "assistant" or not (text or "").lstrip(" ").startswith("{"):
        return role == "tool"
    try:
        return bool(load(text).get("tool_calls"))
    except ValueError:
        return True


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else canonical(value)


def exchange_events(turns: DataFrame, tool: str = "reply", whole: bool = False) -> DataFrame:
    """Events of plain conversations: a user turn calls ``reply`` with its text, the next turn is the result if it is
    the assistant's, and a call comes after the one two turns before. With ``whole`` all other turns are messages."""
    known = turns.filter(F.col("turn").isNotNull() & F.col("text").isNotNull()).select("conv_id", "turn", "role", "text")
    call_turn = F.when(F.col("role") == "user", F.col("turn")).when(F.col("role") == "assistant", F.col("turn") - 1)
    body = F.when(F.col("role") == "user", F.to_json(F.struct("text", "turn"))).otherwise(F.to_json(F.struct("text")))
    events = known.filter(F.col("role").isin("user", "assistant")).select(
        "conv_id", "turn", F.lit(0).alias("position"), F.when(F.col("role") == "user", "call").otherwise("result").alias("kind"),
        F.concat(F.lit("call-"), call_turn.cast("string")).alias("call_id"),
        F.when(F.col("role") == "user", tool).alias("tool"), body.alias("body"), (call_turn - 2).alias("before"))
    asked = known.filter(F.col("role") == "user").select(F.col("conv_id").alias("c"), F.col("turn").alias("t")).distinct()
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("before") == F.col("t")) & (F.col("kind") == "call")
    linked = events.join(asked, same, "left").withColumn("after", F.concat(F.lit("call-"), F.col("t").cast("string"))).select(EVENT)
    if not whole:
        return linked
    replied = F.col("role").isin("user", "assistant") & F.col("turn").isNotNull() & F.col("text").isNotNull()
    return linked.unionByName(_plain(turns.filter(~F.coalesce(replied, F.lit(False)))))


def depths(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, call_id, depth) of calls (conv_id, call_id, after): calls before it; null on or behind a cycle.

    Each round doubles how far a call looks back. A chain of n calls ends after log2(n) rounds; what is still open
    after more rounds than the number of calls has binary digits is on a cycle.
    """
    state = scratch.save(calls.select("conv_id", "call_id", F.col("after").alias("up"), F.when(
        F.col("after").isNull(), 0).otherwise(1).cast("long").alias("depth")), "depth-0")
    rounds = max(1, state.count()).bit_length() + 1
    for step in range(1, rounds + 1):
        above = state.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), F.col("up").alias("higher"), F.col("depth").alias("more"))
        same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("i"))
        moved = state.join(above, same, "left").select(
            "conv_id", "call_id", F.col("higher").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        state, seen = scratch.save_counted(moved, f"depth-{step}", F.count("up").alias("open"))
        if not seen["open"]:
            break
    return state.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def checked(events: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """``events`` with ``fault`` (null, malformed or what a schema refuses) and ``line``, the event in canonical JSON."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_check(row, schemas) for row in batch.to_pylist()]
            for name, k in (("fault", 0), ("line", 1)):
                batch = batch.append_column(name, pa.array([x[k] for x in found], pa.string()))
            yield batch

    return events.select(EVENT).mapInArrow(run, f"{MESSAGE_SCHEMA}, fault string, line string")


def _check(row: dict, schemas: dict[str, dict]) -> tuple[str | None, str]:
    if row["kind"] == "message":
        return "malformed" if _broken(row["tool"], row["body"]) else None, canonical({"role": row["tool"], "content": row["body"]})
    try:
        body, whole = load(row["body"]) if row["body"] is not None else None, True
    except ValueError:
        body, whole = row["body"], False
    if row["kind"] == "result":
        line = {"role": "tool", "tool_call_id": row["call_id"], "content": body}
        return (None if row["call_id"] else "malformed"), canonical(line)
    line = {"role": "assistant", "tool_calls": [{"id": row["call_id"], "type": "function", "function": {"name": row["tool"], "arguments": body}}]}
    if not row["call_id"] or not whole or not isinstance(body, dict):
        return "malformed", canonical(line)
    if row["tool"] not in schemas:
        return "$: no schema for the tool", canonical(line)
    return "; ".join(violations(body, schemas[row["tool"]])) or None, canonical(line)


def link(events: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """A row per event: its status, ``depth`` and ``step`` (2 * depth for a call, one more for its result; null without
    a place in the order), the partner's turn, what a schema refuses, and the canonical line.

    (depth, turn) is a topological order of a conversation: what an event needs has a smaller step.
    """
    scratch = Scratch(events.sparkSession)
    saved = scratch.save(checked(events, schemas), "checked")
    seen, said = saved.filter("kind <> 'message'"), saved.filter("kind = 'message'")
    # the first of each identifier by (turn, position); equal rows count once
    key = ["conv_id", "kind", "call_id"]
    first = F.struct("turn", "position", F.xxhash64("body", "tool", "after"))
    firsts = seen.groupBy(key).agg(F.min(first).alias("first"), F.min_by("after", first).alias("first_after"), F.count_if(F.col("fault") == "malformed").alias("bad"))
    firsts = scratch.save(firsts.filter("call_id is not null"), "firsts")
    calls, results = (firsts.filter(F.col("kind") == k) for k in ("call", "result"))
    named = calls.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"))
    exists = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("first_after") == F.col("i"))
    wired = calls.join(named, exists, "left").select(
        "conv_id", "call_id", F.col("i").alias("after"), (F.col("first_after").isNotNull() & F.col("i").isNull()).alias("lost"), "first")
    wired = scratch.save(wired, "wired")
    ordered = depths(wired.select("conv_id", "call_id", "after"), scratch).select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), "depth")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("call_id") == F.col("i"))
    answers = results.select(F.col("conv_id").alias("rc"), F.col("call_id").alias("ri"), F.col("first").alias("answered"))
    answer = F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("call_id") == F.col("ri"))
    linked = wired.join(ordered, same).join(answers, answer, "left").select(
        F.col("conv_id").alias("lc"), F.col("call_id").alias("li"), "lost", "depth", F.col("first").alias("asked"), "answered")
    at_call = F.col("conv_id").eqNullSafe(F.col("lc")) & (F.col("call_id") == F.col("li"))
    own = firsts.select(F.col("conv_id").alias("oc"), F.col("kind").alias("ok"), F.col("call_id").alias("oi"), F.col("first").alias("own"))
    at_own = F.col("conv_id").eqNullSafe(F.col("oc")) & (F.col("kind") == F.col("ok")) & (F.col("call_id") == F.col("oi"))
    call = F.col("kind") == "call"
    status = (
        F.when(F.col("fault") == "malformed", "malformed")
        .when(first != F.col("own"), "duplicate")
        .when(F.col("li").isNotNull() & F.col("depth").isNull(), "cycle")
        .when(F.col("li").isNull() | (call & F.col("lost")), "orphan")
        .when(F.col("fault").isNotNull(), "invalid")
        .when(call & F.col("answered").isNull(), "unanswered")
        .when(~call & (F.struct("turn", "position") < F.struct("asked.turn", "asked.position")), "early")
        .otherwise("ok"))
    placed = F.col("status").isin("ok", "invalid", "unanswered", "early")
    rows = (
        seen.join(linked, at_call, "left").join(own, at_own, "left")
        .withColumn("status", status)
        .withColumn("depth", F.when(placed, F.col("depth")))
        .select("conv_id", "turn", "position", "kind", "call_id", "tool", "status", "depth",
                (2 * F.col("depth") + F.when(call, 0).otherwise(1)).alias("step"),
                F.when(placed, F.when(call, F.col("answered.turn")).otherwise(F.col("asked.turn"))).alias("partner_turn"),
                F.when(F.col("status") == "invalid", F.col("fault")).alias("fault"), "line"))
    # messages are linked with nothing, so they meet no join either
    status = F.coalesce("fault", F.lit("ok")).alias("status")
    empty = {c: F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("depth", "step", "partner_turn", "fault")}
    return rows.unionByName(said.select(*(status if c == "status" else empty.get(c, F.col(c)) for c in rows.columns)))
