"""Conversations with tool calls: results linked to calls, messages in a valid order, arguments validated, JSON written.

An assistant message may be a JSON object with ``tool_calls`` (objects with ``id``, ``name``, ``arguments``) and
``content``; a message of the role ``tool`` is a JSON object with ``tool_call_id`` and ``content``. Any other text is
plain content. Calls and results of a conversation meet in a hash join by identifier. Arguments that are the string
``$id`` use the result of another call.

Order: a result comes after its call, and a call after the results it uses; otherwise messages keep their turns. A
message's place is (turn, step): its own turn with step 0, or, if something it needs is placed later, that turn with
the next step. Places spread along the links in rounds until nothing changes; messages on a cycle never settle and
keep their own turn. So no conversation is gathered in one task, however long it is.

Null conversation ids form one conversation, null turns come first, null texts are empty content, null roles are
written as null. Of several calls with one identifier, the first by turn counts, and so for results; the others
are marked ``duplicate``. Null arguments are no object; other columns are not read. Rows that are alike in all columns are treated alike.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_rows, work_folder

#: What a tool's arguments must be: name -> {argument: (schema, required)}. A schema is a JSON type or an object with
#: ``type``, ``enum``, ``minimum``, ``maximum``, ``minLength``, ``maxLength``, ``minItems``, ``maxItems``, ``items``,
#: ``properties``, ``required`` and ``additionalProperties``, as in JSON Schema.
Schemas = dict[str, dict[str, tuple[str | dict, bool]]]

TYPES = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
    "null": lambda v: v is None,
}
#: Bounds: (keyword, what is measured, whether the measure must not be below it).
BOUNDS = (
    ("minimum", "number", True), ("maximum", "number", False), ("minLength", "string", True), ("maxLength", "string", False),
    ("minItems", "array", True), ("maxItems", "array", False),
)


def canonical(value) -> str:
    """JSON with sorted keys, no blanks and plain characters."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def misfits(value, schema: str | dict, at: str) -> list[tuple[str, str | None]]:
    """(fault, reference) of a value against a schema. A string ``$id`` may stand for the result of a call, which fits
    everything; its faults count only if there is no such call."""
    schema = {"type": schema} if isinstance(schema, str) else schema
    ref = value[1:] if isinstance(value, str) and len(value) > 1 and value[0] == "$" else None
    kind = schema.get("type")
    if kind is not None and not TYPES[kind](value):
        return [(f"{at} is no {kind}", ref)]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at} is none of its values")
    for word, of, low in BOUNDS:
        if word in schema and TYPES[of](value):
            size = value if of == "number" else len(value)
            if size < schema[word] if low else size > schema[word]:
                found.append(f"{at} is beyond {word} {schema[word]}")
    out = [(x, ref) for x in found]
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += misfits(v, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [(f"missing {at}.{k}", None) for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                out += misfits(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append((f"unexpected {at}.{k}", None))
    return out


def faults(name, arguments, schemas: Schemas) -> list[tuple[str, str | None]]:
    """What is wrong with the arguments of a call, each with the reference that it depends on, if any."""
    if not isinstance(name, str) or name not in schemas:
        return [(f"unknown tool {name if isinstance(name, str) else canonical(name)}", None)]
    if not isinstance(arguments, dict):
        return [("arguments are no object", None)]
    spec = schemas[name]
    found = [(f"missing {a}", None) for a, (_, needed) in spec.items() if needed and a not in arguments]
    for a, v in arguments.items():
        found += misfits(v, spec[a][0], a) if a in spec else [(f"unexpected {a}", None)]
    return sorted(found, key=lambda f: (f[0], f[1] or ""))


def _refuse(word: str):
    raise ValueError(f"{word} is no JSON")


def _finite(digits: str) -> float:
    value = float(digits)
    return value if math.isfinite(value) else _refuse(digits)


def _object(text: str | None) -> dict | None:
    """The JSON object that a text is, else None. NaN and numbers without a finite value are no JSON; half of a
    surrogate pair, which no text can hold, becomes the replacement character."""
    if not text or not text.lstrip().startswith("{"):
        return None
    try:
        value = json.loads(text, parse_constant=_refuse, parse_float=_finite)
        if "\\ud" in text or "\\uD" in text:
            whole = json.dumps(value, ensure_ascii=False).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
            value = json.loads(whole)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _uses(arguments) -> list[str]:
    """Identifiers of the results that arguments use, at any depth."""
    found, todo = set(), [arguments]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            todo.extend(v.values())
        elif isinstance(v, list):
            todo.extend(v)
        elif isinstance(v, str) and len(v) > 1 and v[0] == "$":
            found.add(v[1:])
    return sorted(found)


def read_message(role: str | None, text: str | None, schemas: Schemas) -> tuple:
    """(calls, uses, faults, identifier answered, canonical JSON) of one message."""
    value = _object(text)
    if role == "assistant" and value is not None and isinstance(value.get("tool_calls"), list):
        calls, uses, wrong, written = [], set(), [], []
        for c in value["tool_calls"]:
            c = c if isinstance(c, dict) else {}
            i, name, arguments = c.get("id"), c.get("name"), c.get("arguments")
            if isinstance(arguments, str):
                read = _object(arguments)
                arguments = arguments if read is None else read
            i = i if isinstance(i, str) else canonical(i)
            calls.append(i)
            uses.update(_uses(arguments))
            wrong += [(f"{i}: {x}", ref) for x, ref in faults(name, arguments, schemas)]
            written.append({"arguments": arguments, "id": i, "name": name})
        out = {"content": value.get("content"), "role": role, "tool_calls": written}
        return calls, sorted(uses), wrong, None, canonical(out)
    if role == "tool" and value is not None and "tool_call_id" in value:
        i = value["tool_call_id"]
        i = i if isinstance(i, str) else canonical(i)
        return [], [], [], i, canonical({"content": value.get("content"), "role": role, "tool_call_id": i})
    return [], [], [], None, canonical({"content": text or "", "role": role})


def messages(talk: DataFrame, schemas: Schemas) -> DataFrame:
    """Every message (of_conv, turn, role) read from its ``text``."""
    strings = T.ArrayType(T.StringType())
    adds = T.StructType(
        [T.StructField(n, strings) for n in ("calls", "uses")]
        + [T.StructField("faults", T.DataType.fromDDL("array<struct<fault:string,ref:string>>"))]
        + [T.StructField("answers", T.StringType()), T.StructField("json", T.StringType())]
    )

    def make():
        fault = pa.list_(pa.struct([("fault", pa.string()), ("ref", pa.string())]))
        kinds = [pa.list_(pa.string())] * 2 + [fault] + [pa.string()] * 2

        def work(roles, texts):
            made = list(zip(*(read_message(r, t, schemas) for r, t in zip(roles, texts)))) or [[]] * 5
            made[2] = [[{"fault": f, "ref": r} for f, r in own] for own in made[2]]
            return [pa.array(list(x), k) for x, k in zip(made, kinds)]

        return work

    return map_rows(talk, ["role", "text"], ["of_conv", "turn", "role"], adds, make)


def _first(of: DataFrame, name: str) -> DataFrame:
    """Of the messages that name an identifier, the first: (conv, id, name)."""
    return of.groupBy("conv", "id").agg(F.min(F.struct("turn", "row")).alias(name))


def link(
    talk: DataFrame, schemas: Schemas, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per message: ``conv``, ``turn``, ``role``, its place (``at_turn``, ``at_step``), ``n_calls``,
    ``n_answered`` of them, ``status``, sorted ``faults`` and the canonical ``json``.

    Status: ``plain``; for calls ``answered``, ``unanswered`` or ``duplicate``; for results ``linked``,
    ``orphan`` or ``duplicate``; ``cycle`` for messages whose needs never settle.
    """
    folder = work_folder(talk.sparkSession)
    given = talk.select(F.col(conv).alias("of_conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = messages(given, schemas).withColumn("row", F.monotonically_increasing_id())
    rows = cut(rows.withColumn("conv", F.coalesce(F.col("of_conv").cast("string"), F.lit(""))), folder, "messages")
    called = rows.select("conv", "turn", "row", F.explode("calls").alias("id"))
    answered = rows.where("answers IS NOT NULL").select("conv", "turn", "row", F.col("answers").alias("id"))
    links = _first(called, "call").join(_first(answered, "result"), ["conv", "id"], "full")
    links = cut(links.select("conv", "id", F.col("call.row").alias("call"), F.col("result.row").alias("result")), folder, "links")
    pairs = links.where("call IS NOT NULL AND result IS NOT NULL")
    used = rows.select("conv", "row", F.explode("uses").alias("id")).join(pairs.select("conv", "id", "result"), ["conv", "id"])
    needs = pairs.select(F.col("result").alias("row"), F.col("call").alias("before"))
    needs = needs.unionAll(used.select("row", F.col("result").alias("before"))).where("row <> before").distinct()
    # faults that a reference would excuse, if the conversation has no such call
    maybe = rows.select("conv", "row", F.explode("faults").alias("f")).where("f.ref IS NOT NULL")
    maybe = maybe.select("conv", "row", F.col("f.fault").alias("fault"), F.col("f.ref").alias("id"))
    known = links.where("call IS NOT NULL").select("conv", "id")
    real = maybe.join(known, ["conv", "id"], "left_anti").groupBy("row").agg(F.collect_list("fault").alias("more"))
    places = settle(rows.select("row", "turn"), cut(needs, folder, "needs"), folder)
    by_call = called.join(links, ["conv", "id"]).groupBy("row").agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.sum(((F.col("call") == F.col("row")) & F.col("result").isNotNull()).cast("long")).alias("n_answered"),
        F.max(F.col("call") != F.col("row")).alias("again"),
    )
    by_result = answered.join(links, ["conv", "id"]).select("row", F.col("call").alias("of"), F.col("result").alias("first_result"))
    sure = F.transform(F.filter("faults", lambda f: f["ref"].isNull()), lambda f: f["fault"])
    every = F.sort_array(F.concat(sure, F.coalesce("more", F.array().cast("array<string>")))).alias("faults")
    out = rows.join(real, "row", "left").join(places, "row", "left").join(by_call, "row", "left").join(by_result, "row", "left")
    status = (
        F.when(F.col("cyclic"), "cycle")
        .when(F.col("again"), "duplicate")
        .when(F.col("n_calls") > F.col("n_answered"), "unanswered")
        .when(F.col("n_calls") > 0, "answered")
        .when(F.col("answers").isNull(), "plain")
        .when(F.col("of").isNull(), "orphan")
        .when(F.col("first_result") != F.col("row"), "duplicate")
        .otherwise("linked")
    )
    return out.select(
        F.col("of_conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role),
        F.coalesce("place.turn", "turn").alias("at_turn"), F.coalesce("place.step", F.lit(0)).alias("at_step"),
        F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"),
        F.coalesce("n_answered", F.lit(0)).cast("long").alias("n_answered"),
        status.alias("status"), every, "json",
    )


def settle(rows: DataFrame, needs: DataFrame, folder: str) -> DataFrame:
    """(row, place, cyclic) of the messages with needs: a message is placed once everything before it is."""
    tied = needs.select("row").union(needs.select("before")).distinct()
    own = F.struct(F.col("turn"), F.lit(0).alias("step"))
    free = rows.join(tied, "row", "left_semi").join(needs, "row", "left_anti")
    done = cut(free.select("row", own.alias("place")), folder, "settled-0")
    new, turn = done, 0
    while not new.isEmpty():
        turn += 1
        open_rows = needs.join(done.select("row"), "row", "left_anti")
        reached = open_rows.join(done.select(F.col("row").alias("before"), "place"), "before", "left")
        after = F.struct(F.col("place.turn").alias("turn"), (F.col("place.step") + 1).alias("step"))
        ready = reached.groupBy("row").agg(
            F.max(after).alias("after"), F.max(F.col("place").isNull()).alias("waits")
        ).where("NOT waits")
        placed = ready.join(rows, "row").select("row", F.greatest(own, "after").alias("place"))
        new = cut(placed, folder, f"settled-{turn}")
        done = cut(done.unionByName(new), folder, f"done-{turn}")
    rest = needs.select("row").distinct().join(done, "row", "left_anti")
    rest = rest.select("row", F.lit(None).cast(done.schema["place"].dataType).alias("place"), F.lit(True).alias("cyclic"))
    return done.withColumn("cyclic", F.lit(False)).unionByName(rest)
