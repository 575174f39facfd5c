"""Tool calls: links, order, validation and JSON against brute force."""

import json

from itemnorm.llm import tool_calls as C

TOOLS = {"find": {"q": ("string", True), "n": ("integer", False)}}


def call(i, arguments, name="find"):
    return json.dumps({"tool_calls": [{"id": i, "name": name, "arguments": arguments}]})


def result(i, content="ok"):
    return json.dumps({"tool_call_id": i, "content": content})


def test_one_conversation(spark):
    rows = [
        (1, 0, "user", 'hi "you"\n'), (1, 1, "tool", result("a")), (1, 2, "assistant", call("a", {"q": "x", "n": 1})),
        (1, 3, "assistant", call("b", {"n": "many", "z": 1, "q": "$c"})), (1, 4, "tool", result("b")),
        (1, 9, "assistant", call("c", '{"q": "later"}')), (1, 10, "tool", result("c")), (1, 11, "tool", result("c", "again")),
        (1, 12, "tool", result("nobody")), (1, 13, "assistant", call("d", {}, "other")), (1, 14, "assistant", "plain { text"),
        (2, 0, "assistant", call("x", {"q": "$y"})), (2, 1, "assistant", call("y", {"q": "$x"})), (2, 2, "tool", result("x")),
        (2, 3, "tool", result("y")), (3, 0, None, None), (None, None, "assistant", call("a", {"q": "other talk"})),
        (4, 0, "assistant", call("a", {"q": "1"})), (4, 1, "assistant", call("a", {"q": "2"})), (4, 2, "tool", result("a")),
    ]
    df = spark.createDataFrame([(*r, "s") for r in rows], "conv_id long, turn long, role string, text string, status string")
    got = {(r.conv_id, r.turn): r for r in C.link(df, TOOLS).collect()}
    assert len(got) == len(rows)
    status = {k: r.status for k, r in got.items()}
    assert [status[1, t] for t in (0, 1, 2, 3, 4, 9, 10, 11, 12, 13, 14)] == [
        "plain", "linked", "answered", "answered", "linked", "answered", "linked", "duplicate", "orphan", "unanswered", "plain"]
    assert [status[2, t] for t in range(4)] == ["cycle"] * 4 and status[3, 0] == "plain" and status[None, None] == "unanswered"
    assert [status[4, t] for t in range(3)] == ["answered", "duplicate", "linked"]
    place = {k: (r.at_turn, r.at_step) for k, r in got.items()}
    assert place[1, 1] == (2, 1) and place[1, 3] == (10, 1) and place[1, 4] == (10, 2) and place[1, 9] == (9, 0)
    assert place[2, 0] == (0, 0) and got[1, 2].faults == [] and got[1, 9].faults == []
    assert got[1, 3].faults == ["b: n is no integer", "b: unexpected z"] and got[1, 13].faults == ["d: unknown tool other"]
    assert got[1, 0].json == '{"content":"hi \\"you\\"\\n","role":"user"}' and got[3, 0].json == '{"content":"","role":null}'
    assert got[1, 9].json == '{"content":null,"role":"assistant","tool_calls":[{"arguments":{"q":"later"},"id":"c","name":"find"}]}'
    assert C.link(df.limit(0), TOOLS).count() == 0


def test_long_chain_and_long_conversation(spark):
    rows = []
    for i in range(6):  # each call uses the result of the one after it in turns
        rows += [(1, 2 * i, "assistant", call(f"k{i}", {"q": f"$k{i + 1}"})), (1, 2 * i + 1, "tool", result(f"k{i}"))]
    rows += [(2, i, "user", "x" * (i % 50)) for i in range(3000)]
    got = {(r.conv_id, r.turn): (r.at_turn, r.at_step) for r in C.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), TOOLS).collect()}
    order = sorted((got[1, t], t) for t in range(12))
    assert [t for _, t in order] == [10, 11, 8, 9, 6, 7, 4, 5, 2, 3, 0, 1]
    assert all(got[2, i] == (i, 0) for i in range(3000))


def test_odd_json(spark):
    """Half surrogate pairs, numbers that are no JSON, empty arguments as text, references to calls that do not exist."""
    tools = {"find": {"q": ("string", False), "n": ("integer", False)}}
    rows = [
        (1, 0, "assistant", '{"tool_calls": [{"id": "a", "name": "find", "arguments": {"q": "x\\ud800y \\ud83d\\ude00"}}]}'),
        (1, 1, "assistant", '{"tool_calls": [{"id": "b", "name": "find", "arguments": "{}"}]}'),
        (1, 2, "assistant", '{"tool_calls": [{"id": "c", "name": "find", "arguments": {"n": NaN}}]}'),
        (1, 3, "assistant", '{"tool_calls": [{"id": "d", "name": "find", "arguments": {"n": 1e999}}]}'),
        (1, 4, "assistant", call("e", {"n": "$5", "q": "$5"})), (1, 5, "assistant", call("f", {"n": "$a"})),
        (1, 6, "assistant", call("g", None, 7)), (1, 7, "tool", '{"tool_call_id": "\\udfff"}'),
    ]
    got = {r.turn: r for r in C.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tools).collect()}
    assert "x\ufffdy \U0001f600" in got[0].json and got[0].faults == [] and got[1].faults == []
    assert [got[t].status for t in (2, 3)] == ["plain", "plain"] and all(json.loads(r.json) for r in got.values())
    assert got[4].faults == ["e: n is no integer"] and got[5].faults == [] and got[6].faults == ["g: unknown tool 7"]


def test_nested_schemas():
    spec = {"type": "object", "required": ["unit"], "additionalProperties": False, "properties": {
        "unit": {"type": "string", "enum": ["m", "ft"]}, "sizes": {"type": "array", "maxItems": 2, "items": {"type": "number", "minimum": 0}}}}
    faults = lambda v: [f for f, _ in C.faults("t", {"a": v}, {"t": {"a": (spec, True)}})]
    assert faults({"unit": "m", "sizes": [1, 2.5]}) == []
    assert faults({"unit": "in", "sizes": [1, -2, True], "x": 1}) == [
        "a.sizes is beyond maxItems 2", "a.sizes[1] is beyond minimum 0", "a.sizes[2] is no number", "a.unit is none of its values", "unexpected a.x"]
    assert faults({}) == ["missing a.unit"] and faults([]) == ["a is no object"]
    assert C.faults("t", {"a": "$k"}, {"t": {"a": (spec, True)}}) == [("a is no object", "k")]
