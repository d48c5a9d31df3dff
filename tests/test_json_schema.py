"""Schema validation by hand-computed cases and against a small recursive checker on random values."""

import json
import random

import pytest

from tessera.functions.json_schema import violations
from tessera.operators import reports

CASES = [
    ({"type": "object"}, {}, []), ({"type": "object"}, [], ["$ type"]), ({"type": ["string", "null"]}, None, []), ({"type": "integer"}, 3, []), ({"type": "integer"}, 3.0, []), ({"type": "integer"}, 3.5, ["$ type"]),
    ({"type": "number"}, 3, []), ({"type": "string"}, 3, ["$ type"]), ({"type": "boolean"}, True, []), ({"enum": ["a", 1, {"x": [1]}]}, {"x": [1]}, []), ({"enum": ["a", 1]}, "1", ["$ enum"]), ({"const": "b"}, "a", ["$ const"]),
    ({"required": ["a", "b"]}, {"a": 1}, ["$ required"]), ({"required": ["a"]}, "not an object", []), ({"properties": {"a": {"type": "string"}}}, {"a": 1, "b": 2}, ["$.a type"]),
    ({"properties": {"a": {}}, "additionalProperties": False}, {"a": 1, "b": 2}, ["$ additionalProperties"]), ({"properties": {"a": {}}, "additionalProperties": True}, {"b": 2}, []),
    ({"items": {"type": "integer"}}, [1, "x", 2.5], ["$[1] type", "$[2] type"]), ({"minimum": 2, "maximum": 3}, 1, ["$ minimum"]), ({"maximum": 3}, 3.5, ["$ maximum"]), ({"minLength": 2}, "é", ["$ minLength"]), ({"maxLength": 1}, "ab", ["$ maxLength"]),
    ({"minItems": 1}, [], ["$ minItems"]), ({"maxItems": 1}, [1, 2], ["$ maxItems"]), (True, 5, []), (False, 5, ["$ schema"]), ([], 5, ["$ schema"]), ({"properties": {"a": False}}, {"a": 1}, ["$.a schema"]),
    ({"properties": {"a": {"properties": {"b": {"items": {"properties": {"c": {"type": "null"}}}}}}}}, {"a": {"b": [{"c": None}, {"c": 0}]}}, ["$.a.b[1].c type"]),
]


def test_hand_cases(spark):
    rows = [(i, json.dumps(s), json.dumps(v)) for i, (s, v, _) in enumerate(CASES)] + [(-1, None, "1"), (-2, "{}", None), (-3, "{}", "{no"), (-4, "{no", "1"), (-5, '{"a":1,"a":2}', "1")]
    df = spark.createDataFrame(rows, "i int, s string, v string")
    got = {r.i: r.f for r in df.select("i", violations(df.s, df.v).alias("f")).collect()}
    assert {i: got[i] for i in range(len(CASES))} == {i: w for i, (_, _, w) in enumerate(CASES)}
    assert [got[i] for i in (-1, -2, -3, -4, -5)] == [None, None, ["$ json"], ["$ schema"], ["$ schema"]]


def check(s, v, path="$"):
    if isinstance(s, bool):
        return [] if s else [f"{path} schema"]
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null", int: "number", float: "number"}[type(v)]
    out = []
    if "type" in s and not (s["type"] == kind or s["type"] == "integer" and kind == "number" and v == int(v)):
        out.append(f"{path} type")
    if kind == "object":
        out += [f"{path} required"] if any(k not in v for k in s.get("required", [])) else []
        for k, sub in s.get("properties", {}).items():
            out += check(sub, v[k], f"{path}.{k}") if k in v else []
    if kind == "array" and "items" in s:
        for i, x in enumerate(v):
            out += check(s["items"], x, f"{path}[{i}]")
    if kind == "number" and "maximum" in s and v > s["maximum"]:
        out.append(f"{path} maximum")
    return sorted(set(out))


def test_random_values(spark):
    rng = random.Random(6)

    def value(d):
        return rng.choice([lambda: rng.randrange(9), lambda: rng.random() * 9, lambda: "x", lambda: None, lambda: True, lambda: {k: value(d - 1) for k in "abc" if rng.random() < 0.6} if d else 1, lambda: [value(d - 1) for _ in range(rng.randrange(3))] if d else "y"])()

    def schema(d):
        s = {}
        if rng.random() < 0.4:
            s["type"] = rng.choice(["object", "array", "string", "integer", "number", "boolean", "null"])
        if rng.random() < 0.3:
            s["required"] = rng.sample("abc", 2)
        if d and rng.random() < 0.8:
            s["properties"] = {k: schema(d - 1) for k in "abc"}
        if d and rng.random() < 0.5:
            s["items"] = schema(d - 1)
        if rng.random() < 0.3:
            s["maximum"] = 4
        return rng.choice([s] * 8 + [True, False])

    cases = [(i, schema(3), value(3)) for i in range(300)]
    df = spark.createDataFrame([(i, json.dumps(s), json.dumps(v)) for i, s, v in cases], "i int, s string, v string")
    assert {r.i: r.f for r in df.select("i", violations(df.s, df.v).alias("f")).collect()} == {i: check(s, v) for i, s, v in cases}


def test_depth_is_bounded(spark):
    s, v = {"type": "integer"}, "x"
    for _ in range(5):
        s, v = {"properties": {"a": s}}, {"a": v}
    df = spark.createDataFrame([(json.dumps(s), json.dumps(v))], "s string, v string")
    assert df.select(violations(df.s, df.v, 6)).first()[0] == ["$.a.a.a.a.a type"] and df.select(violations(df.s, df.v, 3)).first()[0] == ["$.a.a.a depth"]


LIMITS = {"metadata": 2_000, "depth": 9, "schema": 600, "example": 100}


@pytest.mark.parametrize(("extension", "code"), [
    ({"info": {"input": {"type": "http", "method": "GET"}}, "schema": {}}, None), ({"info": {"input": {"type": "ftp"}}, "schema": {}}, "spec_invalid"), ({"info": {"input": {"type": "http", "method": "BREW"}}}, "spec_invalid"), ({"info": []}, "spec_invalid"), ({}, "spec_invalid"),
    ({"info": {"input": {"type": "http"}}, "schema": [1]}, "spec_invalid"), ({"info": {"input": {"type": "mcp", "toolName": 7}}}, "spec_invalid"), ({"info": {"input": {"type": "mcp", "inputSchema": "x"}}}, "spec_invalid"),
    ({"info": {"input": {"type": "http", "queryParams": {"city": 5}}}, "schema": {"properties": {"input": {"properties": {"queryParams": {"properties": {"city": {"type": "string"}}}}}}}}, "schema_invalid"),
    ({"info": {"input": {"type": "http", "queryParams": {"city": "Oslo"}}}, "schema": {"type": "object", "properties": {"input": {"properties": {"queryParams": {"required": ["city"]}}}}, "required": ["input"]}}, None),
    ({"info": {"input": {"type": "http"}}, "schema": {"required": ["output"]}}, "schema_invalid"), ({"info": {"input": {"type": "mcp"}}, "schema": {}}, "tool_missing"),
])
def test_extraction_validates(spark, extension, code):
    body = json.dumps({"resource": {"url": "https://api.example/x"}, "extension": extension})
    df = spark.createDataFrame([(body,)], "b string")
    assert df.select(reports.extraction(df.b, LIMITS)["code"]).first()[0] == code
