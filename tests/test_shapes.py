"""Shape validation of values that the registered query does not hold, and of names already there."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.operators.shapes import Attribute, Shape, entity_writes, property_problems


def problems(spark, shape, *values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, props string")
    return [r[0] for r in rows.orderBy("k").select(property_problems(F.col("props"), shape)).collect()]


def test_types(spark):
    values = {"string": '"x"', "integer": "-3", "number": "2.5", "boolean": "false", "object": '{"a":1}', "array": "[]", "null": "null"}
    for kind in values:
        shape = Shape(properties={"a b": {"type": kind}})
        fine = {kind} | ({"integer"} if kind == "number" else set())
        got = problems(spark, shape, *[f'{{"a b":{v}}}' for v in values.values()])
        assert got == [[] if other in fine else [f"property a b must match schema type {kind}"] for other in values]


def test_attributes(spark):
    shape = Shape(attributes=(Attribute("d", "date", True), Attribute("t", "datetime"), Attribute("e", "enum", enum=[1, "é", None, ["x"]]), Attribute("j", "json")))
    rows = {
        '{"d":"2024-02-29","t":"2024-02-29","e":"é","j":{}}': [], '{"d":"20240229","t":"2024-02-29 10:00","e":["x"]}': [], '{"d":"2024-02-29","t":"2024-02-29T10:00:00.5+02:00","e":null}': [],
        '{"d":"2023-02-29","t":"2024-02-29T24:61","e":"1"}': ["attribute d must be date", "attribute t must be datetime", "attribute e must be one of [1, 'é', None, ['x']]"],
        '{"d":20240229,"t":"soon"}': ["attribute d must be date", "attribute t must be datetime"], "{}": ["missing required attribute: d"], None: ["missing required attribute: d"],
        "": ["properties must be an object"], "not json": ["properties must be an object"], "null": ["properties must be an object"], '"{}"': ["properties must be an object"], '{"d":null}': ["attribute d must be date"],
    }
    assert dict(zip(rows, problems(spark, shape, *rows), strict=True)) == rows


def test_rules_that_cannot_be(spark):
    with pytest.raises(ValueError, match="unsupported"):
        property_problems(F.lit("{}"), Shape(attributes=(Attribute("a", "colour"),)))
    with pytest.raises(ValueError, match="quotes"):
        property_problems(F.lit("{}"), Shape(required=("a'b",)))


def test_one_active_entity_of_a_name(spark):
    rows = [(1, "t", "Anna", "draft"), (2, "t", " ANNA ", "active"), (3, "t", "anna", "draft"), (4, "u", "anna", "active"), (5, "t", "Bert", "active"), (6, "t", "", "active"), (7, "t", None, "active"), (8, "x", "anna", "active"), (9, "t", "anna", "active"), (10, None, "anna", "draft")]
    df = spark.createDataFrame(rows, "ord long, type_key string, name string, status string").withColumn("props", F.lit(None).cast("string"))
    there = spark.createDataFrame([("t", "bert"), ("t", "bert")], "type_key string, form string")
    got = {r["ord"]: r["problems"] for r in entity_writes(df, {"t": Shape(), "u": Shape()}, there).collect()}
    taken, unnamed, no_type = "active entity of this name exists", "canonical_name must be non-empty", "entity type is not active"
    assert got == {1: [], 2: [], 3: [taken], 4: [], 5: [taken], 6: [unnamed], 7: [unnamed], 8: [no_type], 9: [taken], 10: [no_type]}
