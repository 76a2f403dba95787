import json

from siftwell.llm import tool_calls
from siftwell.llm.tool_calls import valid

TOOLS = '<tools>[{"name": "sum", "parameters": {"type": "object", "properties": {"a": {"type": "integer"}}, "required": ["a"], "additionalProperties": false}}]</tools>'


def call(id, name="sum", arguments=None, deps=()):
    return f"<tool_call>{json.dumps({'id': id, 'name': name, 'arguments': arguments if arguments is not None else {'a': 1}, 'depends_on': list(deps)})}</tool_call>"


def result(id, content):
    return f"<tool_result>{json.dumps({'id': id, 'content': content})}</tool_result>"


def test_links(spark):
    rows = [
        (1, 0, "system", TOOLS),
        (1, 1, "assistant", "x " + call("c", arguments={"a": {"$ref": "b"}}) + call("b", deps=["a"]) + call("a", arguments={"a": "no"}) + call("a")),
        (1, 2, "tool", result("b", {"z": 1, "a": "é"}) + result("zz", 1)),
        (1, 3, "tool", result("b", 2)),
        (2, 0, "assistant", call("p", deps=["q"]) + call("q", deps=["p"]) + call("b", "other", {"any": 1}) + "<tool_call>{bad</tool_call>"),
        (None, 0, "assistant", call("b")),
        (3, 0, None, None),
        (3, 0, None, None),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, content string, row_key int")
    got = {(r.conv_id, r.turn): r for r in tool_calls.link(df).collect()}
    r = got[1, 1]
    assert (r.n_calls, r.n_linked, r.n_valid) == (4, 1, 3)
    calls = json.loads(r.json)["tool_calls"]
    assert [(c["id"], c["status"]) for c in calls] == [("a", "pending"), ("a", "duplicate"), ("b", "linked"), ("c", "pending")]
    assert calls[2]["result"] == {"a": "é", "z": 1} and not calls[0]["valid"] and '"result":{"a":"é","z":1}' in r.json
    assert got[1, 2].n_orphans == 1 and got[1, 3].n_orphans == 0
    r = got[2, 0]
    assert [(c["id"], c["status"]) for c in json.loads(r.json)["tool_calls"]] == [("b", "pending"), ("p", "cycle"), ("q", "cycle")] and r.n_bad == 1
    assert json.loads(got[None, 0].json)["tool_calls"][0]["status"] == "pending"
    assert got[3, 0].json == '{"content":"","role":""}' and tool_calls.link(df).count() == len(rows)
    assert tool_calls.link(df.where("turn < 0")).count() == 0


def test_valid():
    assert valid(1.0, {"type": "integer"}) and not valid(True, {"type": "number"}) and valid(None, {"type": ["null", "string"]})
    assert not valid("x", {"enum": ["y"]}) and valid([1, 2], {"type": "array", "items": {"minimum": 1}}) and not valid([0], {"items": {"minimum": 1}})
    assert not valid({}, {"required": ["a"]}) and not valid("abc", {"maxLength": 2}) and not valid({"b": 1}, {"additionalProperties": False})


def test_valid_knows_the_other_keywords():
    bad = [
        ("ab", {"pattern": "^a$"}), (1, {"anyOf": [{"type": "string"}, {"minimum": 2}]}), (1, {"oneOf": [{"minimum": 0}, {"maximum": 2}]}), (1, {"allOf": [{"minimum": 2}]}), (1, {"not": {"type": "integer"}}),
        (1, {"exclusiveMinimum": 1}), (1, {"minimum": 1, "exclusiveMinimum": True}), (1, {"exclusiveMaximum": 1}), (0.35, {"multipleOf": 0.1}), ([1, 1.0], {"uniqueItems": True}), ({}, {"minProperties": 1}), ({"a": 1}, {"maxProperties": 0}),
        ({"a": {"a": 1}}, {"$defs": {"n": {"type": "object"}}, "properties": {"a": {"properties": {"a": {"$ref": "#/$defs/n"}}}}}), ({"x1": "s"}, {"patternProperties": {"^x": {"type": "integer"}}}), ([1], {"contains": {"type": "string"}}),
        ({"a": 1}, {"dependentRequired": {"a": ["b"]}}), ({"a": 1}, {"if": {"required": ["a"]}, "then": {"required": ["b"]}}), ([1, "x"], {"prefixItems": [{}, {"type": "integer"}]}), ({"ab": 1}, {"propertyNames": {"maxLength": 1}}),
    ]
    for value, schema in bad:
        assert valid(value, schema) is False, (value, schema)
        assert "$defs" in schema or valid(value, {"not": schema}) is True, (value, schema)
    assert valid(0.3, {"multipleOf": 0.1}) is True and valid({"x1": 2}, {"patternProperties": {"^x": {}}, "additionalProperties": False}) is True
    for schema in ({"format": "email"}, {"$ref": "http://x.example/s"}, {"$ref": "#"}, {"pattern": "("}, {"not": {"format": "email"}}):
        assert valid("x", schema) is None, schema
    assert valid("x", {"format": "email", "maxLength": 0}) is False


def test_unchecked_calls_are_not_valid(spark):
    tools = '<tools>[{"name": "sum", "parameters": {"properties": {"a": {"format": "date"}}}}]</tools>'
    df = spark.createDataFrame([(1, 0, "system", tools), (1, 1, "assistant", call("c", arguments={"a": "x"}))], "conv_id long, turn long, role string, text string")
    r = tool_calls.link(df).where("turn = 1").first()
    assert r.n_calls == 1 and r.n_valid == 0 and json.loads(r.json)["tool_calls"][0]["valid"] is None


def test_odd_blocks_stay(spark):
    odd = '<tool_call>{"id": "a", "name": "f", "arguments": {"x": 1e999}}</tool_call>'
    half = '<tool_call>{"id": "b", "name": "f", "arguments": {"x": "\\ud800", "y": 12345678901234567890123}}</tool_call>'
    tools = '<tools>[{"name": "f", "parameters": {"minimum": "x"}}, {"parameters": 1}, {"name": "g", "parameters": {"type": {"a": 1}}}]</tools>'
    deep = "<tool_result>" + "[" * 100_000 + "</tool_result>"
    rows = [(1, 0, "system", tools), (1, 1, "assistant", " early " + result("b", 0) + odd + half), (1, 2, "tool", result("b", 7)), (1, 3, "tool", deep + "y" * 300_000), (1, 4, "tool", "<tool_result>{}</tool_result>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.turn: r for r in tool_calls.link(df).collect()}
    r = json.loads(got[1].json)
    assert got[1].n_bad == 1 and r["unreadable"] == [odd] and got[1].n_orphans == 1 and r["content"] == " early "
    assert r["tool_calls"][0]["arguments"] == {"x": "\ud800", "y": 12345678901234567890123} and r["tool_calls"][0]["result"] == 7
    assert [t["name"] for t in json.loads(got[0].json)["tools"]] == ["f", "g"] and json.loads(got[0].json)["unreadable"] == ['{"parameters":1}']
    assert got[3].n_bad == 1 and len(json.loads(got[3].json)["content"]) == 300_000 and got[4].n_bad == 1
    for schema in ({"minimum": "x"}, {"type": {"a": 1}}, {"required": 5}, {"multipleOf": 0}):
        assert valid(1, schema) is not True or schema == {"required": 5}
    assert valid(1e308, {"type": "integer"}) is True


def test_malformed_keywords_are_unchecked():
    assert valid({"a": 1}, {"required": "a"}) is None and valid({"a": 1}, {"properties": {"a": 5}}) is None
    assert valid(1, 5) is None and valid(1, {"enum": 1}) is None and valid([1], {"items": "x"}) is None
    assert valid({"a": 1}, {"required": "a", "properties": {"a": {"type": "string"}}}) is False


def test_numbers_are_equal_by_value():
    assert valid(1, {"enum": [1.0]}) is True and valid([{"a": 2.0}], {"const": [{"a": 2}]}) is True
    assert valid(1, {"enum": ["1", True]}) is False and valid(1.5, {"enum": [1]}) is False
