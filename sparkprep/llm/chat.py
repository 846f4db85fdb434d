"""Tool-call linking for conversations.

Every turn becomes events: a message, and the calls and results it carries. A
call has an identifier, a tool name and arguments; a result names the identifier
it answers. Calls and results are hash-joined by (conversation, identifier);
events are put in topological order (a result after its call, a call after those
its ``after`` list names); arguments are checked against the tool's schema; each
event becomes one line of canonical JSON (sorted keys, no white space, no
escapes beyond those JSON needs).

Where turns carry calls: an assistant's text may hold
``<tool_call>{"id": .., "name": .., "arguments": {..}, "after": [..]}</tool_call>``
and a tool turn's text may be ``{"tool_call_id": .., "content": ..}``. Besides, a
user's turn t of conversation c is itself the call ``c:t`` of the tool ``reply``
with arguments ``{"prompt": text}``, which the assistant's turn t + 1 answers.

Order: an event's time is its turn, or that of the latest event it must follow
if that is later; events are ordered by time, then by depth (the length of the
longest chain that leads to them at this time), turn, and place in the turn.
Circles are found first, by rounds of joins over the ``after`` lists of the
conversations in which a call waits for a later one; then times, by rounds of
joins, one per link of the longest chain that runs against the turns. The order
within a conversation is a rank in two levels, so a conversation of any length is
spread over tasks.

Defined results: of calls with one identifier in a conversation the first is
linked, later ones are ``duplicate``; a call without a result is ``unanswered``, a
result without a call is an ``orphan``; calls that wait for each other in a circle
keep their own turns and are ``cyclic`` (not what merely waits for them, nor what
they wait for outside the circle); text that holds no valid JSON where a call
or result is due, or JSON that UTF-8 and doubles can't hold (``_loads``), stays a message; null text counts as empty, null turns come
first, a null conversation is one of its own; repeated rows each give an event;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, reliable, running_offsets, written

_CALL = re.compile(r"<tool_call>\s*(.*?)\s*</tool_call>", re.S)
TURNS_PER_BUCKET = 256
#: Schemas by tool name; a tool without one takes any object.
SCHEMAS = {"reply": {"type": "object", "required": ["prompt"], "additionalProperties": False,
                     "properties": {"prompt": {"type": "string", "minLength": 1}}}}
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value) -> str:
    """One spelling per JSON value: whole floats are integers, keys are sorted."""

    def plain(v):
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        return int(v) if isinstance(v, float) and math.isfinite(v) and v == int(v) else v
    return json.dumps(plain(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def _loads(text: str):
    """Strict JSON; None if it isn't, or if it can't be written as canonical JSON in
    UTF-8: numbers beyond a double or of thousands of digits, halves of surrogate
    pairs, nesting deeper than Python's recursion."""
    def bad(_):
        raise ValueError("not a JSON number")

    def number(digits: str) -> float:
        x = float(digits)
        return x if math.isfinite(x) else bad(digits)
    try:
        value = json.loads(text, parse_constant=bad, parse_float=number)
        canonical({"content": value, "of": [value]}).encode()  # one level more than any line holds it in
        return value
    except (ValueError, RecursionError):
        return None


def same_json(a, b) -> bool:
    """Equality of JSON values: a truth value is no number, 1 and 1.0 are one number."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same_json(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same_json, a, b))
    return type(a) is type(b) and a == b or isinstance(a, int | float) and isinstance(b, int | float) and a == b


def schema_errors(value, schema: dict, at: str = "$") -> list[str]:
    """Where a value breaks a JSON schema (the keywords below)."""
    kind = schema.get("type")
    kinds = kind if isinstance(kind, list) else [kind] if kind else []
    number = isinstance(value, int | float) and not isinstance(value, bool)

    def is_a(k: str) -> bool:
        return number and (k == "number" or k == "integer" and (isinstance(value, int) or value.is_integer())) or k in _TYPES and isinstance(value, _TYPES[k])

    if kinds and not any(is_a(k) for k in kinds):
        return [f"{at}: not of type {'/'.join(kinds)}"]
    out = []
    if "enum" in schema and not any(same_json(value, x) for x in schema["enum"]):
        out.append(f"{at}: not in enum")
    if "const" in schema and not same_json(value, schema["const"]):
        out.append(f"{at}: not the constant")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at}: shorter than {schema['minLength']}")
        if len(value) > schema.get("maxLength", math.inf):
            out.append(f"{at}: longer than {schema['maxLength']}")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: pattern not found")
    if number:
        if value < schema.get("minimum", -math.inf):
            out.append(f"{at}: under the minimum")
        if value > schema.get("maximum", math.inf):
            out.append(f"{at}: over the maximum")
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0) or len(value) > schema.get("maxItems", math.inf):
            out.append(f"{at}: wrong number of items")
        for i, x in enumerate(value if "items" in schema else []):
            out += schema_errors(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}: no {k}" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                out += schema_errors(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}: unknown {k}")
    return out


def _events(schemas: dict, turns_are_calls: bool):
    kind = pa.schema([("kind", pa.string()), ("place", pa.int32()), ("call_id", pa.string()), ("name", pa.string()), ("body", pa.string()),
                      ("after", pa.list_(pa.string())), ("errors", pa.list_(pa.string()))])

    def of_turn(conv, turn, role, text: str) -> list[dict]:
        out, place = [], 0

        def add(kind, body, call_id=None, name=None, after=(), errors=None) -> None:
            nonlocal place
            out.append({"kind": kind, "place": place, "call_id": call_id, "name": name, "body": body, "after": list(after), "errors": errors})
            place += 1

        if role == "tool":
            found = _loads(text)
            if isinstance(found, dict) and isinstance(found.get("tool_call_id"), str):
                add("result", canonical(found.get("content")), found["tool_call_id"])
                return out
        if turns_are_calls and role == "assistant" and turn is not None:
            add("result", canonical(text), f"{conv}:{turn - 1}")
        elif turns_are_calls and role == "user" and turn is not None:
            arguments = {"prompt": text}
            add("call", canonical(arguments), f"{conv}:{turn}", "reply", errors=schema_errors(arguments, schemas.get("reply", {})))
        else:
            add("message", canonical(text))
        if role == "assistant":
            for raw in _CALL.findall(text):
                c = _loads(raw)
                if isinstance(c, dict) and isinstance(c.get("id"), str) and isinstance(c.get("name"), str):
                    arguments, after = c.get("arguments", {}), c.get("after", [])
                    errors = schema_errors(arguments, {"type": "object"} | schemas.get(c["name"], {}))
                    good = isinstance(after, list) and all(isinstance(x, str) for x in after)
                    add("call", canonical(arguments), c["id"], c["name"], dict.fromkeys(after) if good else (),
                        errors + ([] if good else ["after: not a list of identifiers"]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, events = [], []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")]
            for r, (conv, turn, role, text) in enumerate(zip(*columns, strict=True)):
                found = of_turn(conv, turn, role, text or "")
                rows += [r] * len(found)
                events += found
            take = pa.array(rows, pa.int64())
            table = pa.RecordBatch.from_pylist(events, schema=kind)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(take) for c in ("conv_id", "turn", "role")] + list(table.columns),
                                             names=["conv_id", "turn", "role", *kind.names])
    return run


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges (event, before) without those that lead out of no other edge or
    into none: what is left lies on circles or between them."""
    n, kept = -1, reliable(edges)
    while (m := kept.count()) != n and m:
        n = m
        kept = reliable(kept.join(kept.select(F.col("event").alias("before")).distinct(), "before", "left_semi")
                        .join(kept.select(F.col("before").alias("event")).distinct(), "event", "left_semi").select("event", "before"))
    return kept


def _circles(edges: DataFrame) -> DataFrame:
    """The events on circles of the edges (event, before): each takes the greatest
    event that leads to it as its colour; an event of its own colour and what leads
    back to it within the colour are on circles. The rest goes round again."""
    found = edges.select("event").limit(0)
    edges = _trimmed(edges)
    while not edges.isEmpty():
        colours = reliable(edges.select("event").union(edges.select("before")).distinct().withColumn("colour", F.col("event")))
        while True:
            led = edges.join(colours.select(F.col("event").alias("before"), "colour"), "before").groupBy("event").agg(F.max("colour").alias("led"))
            step = reliable(colours.join(led, "event", "left").select("event", F.greatest("colour", F.coalesce("led", "colour")).alias("colour"),
                                                                      F.coalesce(F.col("led") > F.col("colour"), F.lit(False)).alias("moved")))
            colours = step.select("event", "colour")
            if step.filter("moved").isEmpty():
                break
        within = reliable(edges.join(colours, "event").join(colours.select(F.col("event").alias("before"), F.col("colour").alias("of")), "before")
                          .filter("colour = of").select("event", "before"))
        roots = reliable(colours.filter("event = colour").select("event"))
        back, last = reliable(roots.limit(0)), roots
        while not last.isEmpty():
            last = reliable(within.join(last, "event", "left_semi").select(F.col("before").alias("event")).distinct().join(back, "event", "left_anti"))
            back = reliable(back.union(last))
        found = reliable(found.union(back))
        gone = back.union(roots).distinct()
        edges = _trimmed(within.join(gone, "event", "left_anti").join(gone.select(F.col("event").alias("before")), "before", "left_anti").select("event", "before"))
    return found


def _timed(events: DataFrame, edges: DataFrame, circles: DataFrame) -> DataFrame:
    """(event, time and depth, cyclic) by relaxing the edges (event, before) round by
    round until nothing changes. Events on circles wait for nothing, so no circle is left."""
    times = events.select("event", F.struct(F.col("turn").alias("time"), F.lit(0).alias("depth")).alias("at"))
    waits = reliable(edges.join(circles, "event", "left_anti").select("event", "before"))
    ends = reliable(waits.select("event").union(waits.select(F.col("before").alias("event"))).distinct())
    open_times = reliable(times.join(ends, "event"))
    while True:
        late = (waits.join(open_times.select(F.col("event").alias("before"), F.col("at").alias("b")), "before")
                .groupBy("event").agg(F.max(F.struct(F.col("b.time").alias("time"), (F.col("b.depth") + 1).alias("depth"))).alias("need")))
        step = open_times.join(late, "event", "left")
        need = F.when(F.col("need.time") >= F.col("at.time"), F.col("need")).when(F.col("at.time").isNull(), F.col("need"))
        step = reliable(step.select("event", F.coalesce(F.greatest("at", need), "at").alias("at"),
                                    F.coalesce(F.greatest("at", need) > F.col("at"), F.lit(False)).alias("moved")))
        open_times = step.select("event", "at")
        if step.filter("moved").limit(1).count() == 0:
            break
    return (times.join(open_times.withColumnRenamed("at", "late"), "event", "left").join(circles.withColumn("cyclic", F.lit(True)), "event", "left")
            .select("event", F.coalesce("late", "at").alias("at"), F.coalesce("cyclic", F.lit(False)).alias("cyclic")))


def linked(conversations: DataFrame, schemas: dict | None = None, turns_are_calls: bool = True) -> DataFrame:
    """conv_id, position (gapless from 0), turn, role, kind, call_id, status,
    valid, errors and json of every event."""
    schemas = SCHEMAS if schemas is None else schemas
    base = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    conv = base.schema["conv_id"].dataType.simpleString()
    events = written(arrow_map(base, _events(schemas, turns_are_calls),
                               f"conv_id {conv}, turn long, role string, kind string, place int, call_id string, name string, body string, "
                               "after array<string>, errors array<string>")
                     .withColumn("event", F.monotonically_increasing_id()), "chat-events")
    conversation = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null"))
    key = F.concat(conversation, F.lit("/"), F.col("call_id"))
    place = F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), "place")
    calls = events.filter("kind = 'call'").select(key.alias("k"), "event", place.alias("at"))
    first = reliable(calls.groupBy("k").agg(F.min(F.struct("at", "event")).alias("f")).select("k", F.col("f.event").alias("call"), F.col("f.at").alias("call_at")))
    results = events.filter("kind = 'result'").select(key.alias("k"), "event")
    answers = reliable(results.join(first, "k", "left").select("event", "call"))
    waits = reliable(events.filter("kind = 'call'").select("event", "conv_id", place.alias("at"), F.explode("after").alias("call_id"))
                     .select("event", "at", conversation.alias("c"), key.alias("k")).join(first, "k").filter("event != call")
                     .select("event", F.col("call").alias("before"), "c", (F.col("at") <= F.col("call_at")).alias("against")))
    # a circle has a call that waits for a later one
    circles = _circles(waits.join(waits.filter("against").select("c").distinct(), "c", "left_semi").select("event", "before").distinct())
    edges = answers.filter("call IS NOT NULL").select("event", F.col("call").alias("before")).union(waits.select("event", "before"))
    times = _timed(events, edges, circles)
    answered = answers.filter("call IS NOT NULL").select(F.col("call").alias("event")).distinct().withColumn("answered", F.lit(True))
    state = (events.join(times, "event").join(answers.withColumnRenamed("call", "of"), "event", "left").join(answered, "event", "left")
             .join(first.select(F.col("call").alias("event"), F.lit(True).alias("is_first")), "event", "left"))
    status = (F.when(F.col("cyclic"), "cyclic").when(F.col("kind") == "message", "message")
              .when(F.col("kind") == "result", F.when(F.col("of").isNull(), "orphan").otherwise("linked"))
              .when(F.col("is_first").isNull(), "duplicate").when(F.col("answered"), "answered").otherwise("unanswered"))
    state = written(state.withColumn("status", status)
                    .withColumn("bucket", F.coalesce(F.expr(f"floor(at.time / {TURNS_PER_BUCKET})"), F.lit(-(1 << 52)))), "chat-linked")
    offsets = running_offsets(state.groupBy("conv_id", "bucket").agg(F.count("*").alias("n")).withColumn("conv_key", F.struct("conv_id")), ["conv_key"], "bucket")
    offsets = offsets.select(F.col("conv_key.conv_id").alias("c"), F.col("bucket").alias("b"), "offset")
    w = Window.partitionBy("conv_id", "bucket").orderBy("at.time", "at.depth", "turn", "place", "role", "body", "event")
    ranked = (state.withColumn("r", F.row_number().over(w))
              .join(offsets, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("bucket") == F.col("b")))
              .withColumn("position", F.col("offset") + F.col("r") - 1))

    def to_json(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for e in batch.select(["kind", "role", "call_id", "name", "body", "status", "errors"]).to_pylist():
                line = {"kind": e["kind"], "role": e["role"]}
                if e["kind"] == "message":
                    line["content"] = json.loads(e["body"])
                elif e["kind"] == "result":
                    line |= {"tool_call_id": e["call_id"], "content": json.loads(e["body"]), "status": e["status"]}
                else:
                    line |= {"id": e["call_id"], "name": e["name"], "arguments": json.loads(e["body"]), "status": e["status"], "valid": not e["errors"]}
                lines.append(canonical(line))
            keep = ["conv_id", "position", "turn", "role", "kind", "call_id", "status", "errors"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(lines, pa.string())], names=[*keep, "json"])

    out = arrow_map(ranked.select("conv_id", "position", "turn", "role", "kind", "call_id", "status", F.coalesce("errors", F.array().cast("array<string>")).alias("errors"),
                                  "name", "body"), to_json,
                    f"conv_id {conv}, position long, turn long, role string, kind string, call_id string, status string, errors array<string>, json string")
    return out.withColumn("valid", F.when(F.col("kind") == "call", F.size("errors") == 0))
