"""JSON of any depth: canonical form as the standard library writes it, nodes, offences of odd records."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import nested
from lodestone.operators import privacy

VALUES = [
    {}, [], None, True, 0, -5, 0.25, "text", "", {"b": 1, "a": [{"z": None, "y": {"k": "v", "j": [1, 2, {"q": False}]}}], "A": "é 日本"}, {"": {"": {"": []}}}, ["\u0000\u0001\u001f\u000b\u000e\n\t\r\b\f\"\\/", "\\u001F", "\\\\u000B", "\x7f"],
    {"k" * 300: "x" * 70_000}, [[[[[[[[[[[1]]]]]]]]]]], 12345678901234567890, {"a.b": 1, "a": {"b": 2}},
]


def test_canonical(spark):
    rows = [(k, json.dumps(v, indent=2, ensure_ascii=k % 2 == 0), json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(",", ":"))) for k, v in enumerate(VALUES)]
    rows += [(100, "no json", None), (101, None, None), (102, '{"a":1,"a":2}', None), (103, "", None), (104, "1.0", "1"), (105, "1.50", "1.5")]
    df = spark.createDataFrame(rows, "k int, given string, expected string")
    assert [tuple(r) for r in df.select("k", nested.canonical_json(F.col("given")).alias("got"), "expected").where("NOT (got <=> expected)").collect()] == []


def plain_nodes(value, path="$", name=None, level=0):
    yield path, name, level
    inside = [(f"{path}.{k}", k, v) for k, v in value.items()] if isinstance(value, dict) else [(f"{path}[{i}]", None, v) for i, v in enumerate(value)] if isinstance(value, list) else []
    for p, n, v in inside:
        yield from plain_nodes(v, p, n, level + 1)


@pytest.mark.parametrize("depth", [1, 3, 12])
def test_nodes(spark, depth):
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(VALUES)] + [(100, "no json"), (101, None)], "k int, j string")
    got = sorted(((r["k"], r["path"], r["name"], r["level"]) for r in nested.nodes(df, "k", "j", depth).drop("value").collect()), key=str)
    assert got == sorted(((k, *n) for k, v in enumerate(VALUES) for n in plain_nodes(v) if n[2] <= depth), key=str)
    opened = {r["k"] for r in nested.nodes(df, "k", "j", depth).where("open").select("k").collect()}
    assert opened == {k for k, v in enumerate(VALUES) if any(n[2] > depth for n in plain_nodes(v))}


def test_offences(spark):
    rows = [(1, '{"a":1,"b":[]}'), (2, '{"a":1}'), (3, '{"a":{"SQL":1},"b":["Exception","x SECRET y"]}'), (4, "[]"), (5, None), (6, "no"), (7, '{"a":[[[1]]],"b":2,"c":{}}'), (8, '{"my secret":1,"a":1,"b":5}')]
    df = spark.createDataFrame(rows, "k int, j string")
    got = sorted(tuple(r) for r in privacy.offences(df, "k", "j", allowed=("a", "b"), forbidden=("Secret", ""), depth=3).collect())
    assert got == [
        (2, "$.b", "missing field"), (3, "$.a.SQL", "private field"), (3, "$.b[0]", "private field"), (3, "$.b[1]", "private marker"), (4, "$", "not an object"), (5, "$", "not an object"), (6, "$", "not an object"),
        (7, "$.a[0][0]", "too deep"), (7, "$.c", "unexpected field"), (8, "$.my secret", "private marker"), (8, "$.my secret", "unexpected field"),
    ]


def test_escape_patterns_only_where_an_escape_is():
    """Nine patterns over every text took most of the time: they are for texts that hold an escape."""
    said = str(nested.canonical_json(F.col("x")))
    assert said.index("contains(") < said.index("regexp_replace(")
