"""Shapes of things that are to be written: properties against a schema and attribute rules, names, relations against constraints.

Schemas and attribute rules are compiled into columns over VARIANT, so a table is validated in one pass without a row of
Python. Where a writer stops at the first thing that is wrong, `property_problems` lists all of them, in that order.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import scores
from lodestone.functions import text as tx

DATE = r"^\d{4}-?\d{2}-?\d{2}$"
DATETIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"


@dataclass(frozen=True)
class Attribute:
    """An active attribute rule of a type."""

    key: str
    value_type: str
    required: bool = False
    enum: Sequence[Any] | None = None


@dataclass(frozen=True)
class Shape:
    """What a type asks of properties: `required` keys, and of each key in `properties` a "type" (or several) and an "enum"."""

    required: Sequence[str] = ()
    properties: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    attributes: Sequence[Attribute] = ()


def _value(props: Column, key: str) -> Column:
    if "'" in key or "\\" in key:
        raise ValueError(f"no path to a key with quotes: {key}")
    return F.try_variant_get(props, f"$['{key}']", "variant")


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _is(value: Column, name: str) -> Column:
    """Whether a value (not null as a column) is of a type; a name that is no type asks nothing."""
    kind, whole = _kind(value), _kind(value) == "BIGINT"
    tests = {"string": kind == "STRING", "text": kind == "STRING", "integer": whole, "number": whole | F.startswith(kind, F.lit("DECIMAL")) | (kind == "DOUBLE") | (kind == "FLOAT"), "boolean": kind == "BOOLEAN", "object": F.startswith(kind, F.lit("OBJECT")), "array": F.startswith(kind, F.lit("ARRAY")), "null": kind == "VOID"}
    return tests.get(name, F.lit(True))


def _among(value: Column, values: Sequence[Any]) -> Column:
    return F.to_json(value).isin(*[json.dumps(v, ensure_ascii=False, separators=(",", ":"), sort_keys=True) for v in values]) if values else F.lit(False)


def _dated(value: Column, pattern: str, kind: str) -> Column:
    text = F.when(_is(value, "string"), F.try_variant_get(value, "$", "string"))
    plain = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return F.coalesce(F.regexp_like(text, F.lit(pattern)) & F.replace(plain, F.lit(","), F.lit(".")).try_cast(kind).isNotNull(), F.lit(False))


def property_problems(props: Column, shape: Shape) -> Column:
    """All that is wrong with properties (JSON text; null: none), in the order in which it is looked at: required ones, types and enums of the schema, attributes."""
    parsed = F.try_parse_json(F.coalesce(props, F.lit("{}")))
    ok = F.coalesce(F.startswith(_kind(parsed), F.lit("OBJECT")), F.lit(False))
    rules: list[tuple[Column, str]] = [(~ok, "properties must be an object")]
    there = lambda key: ok & _value(parsed, key).isNotNull()
    rules += [(ok & _value(parsed, key).isNull(), f"missing required property: {key}") for key in shape.required]
    for key, asked in shape.properties.items():
        types = asked.get("type")
        if types is not None:
            any_of = [_is(_value(parsed, key), t) for t in ([types] if isinstance(types, str) else types)]
            test = any_of[0]
            for t in any_of[1:]:
                test = test | t
            rules.append((there(key) & ~test, f"property {key} must match schema type {types}"))
        if asked.get("enum") is not None:
            rules.append((there(key) & ~_among(_value(parsed, key), asked["enum"]), f"property {key} must be one of {asked['enum']}"))
    for a in shape.attributes:
        value = _value(parsed, a.key)
        if a.required:
            rules.append((ok & value.isNull(), f"missing required attribute: {a.key}"))
        if a.value_type == "enum":
            rules.append((there(a.key) & ~_among(value, a.enum or ()), f"attribute {a.key} must be one of {None if a.enum is None else list(a.enum)}"))
        elif a.value_type in ("date", "datetime"):
            rules.append((there(a.key) & ~_dated(value, *((DATE, "date") if a.value_type == "date" else (DATETIME, "timestamp"))), f"attribute {a.key} must be {a.value_type}"))
        elif a.value_type in ("string", "text", "integer", "number", "boolean"):
            rules.append((there(a.key) & ~_is(value, a.value_type), f"attribute {a.key} must be {a.value_type}"))
        elif a.value_type != "json":
            raise ValueError(f"unsupported attribute value_type: {a.value_type}")
    return scores.reasons(*rules)


def entity_writes(rows: DataFrame, shapes: Mapping[str, Shape], active: DataFrame | None = None) -> DataFrame:
    """ord, form, problems: what is wrong with each write of an entity, nothing where it is accepted.

    rows: ord (the order of the writes, unique), type_key, name, props (JSON text), status asked for; active: type_key, form
    of those that are there. A type without a shape is not active. A write is refused if an active entity of its type has its
    normal form already, or if an earlier write that is accepted makes one; refused writes make none.
    """
    problems = F.array(F.lit("entity type is not active"))
    for key, shape in shapes.items():
        problems = F.when(F.col("type_key") == key, property_problems(F.col("props"), shape)).otherwise(problems)
    form = tx.graph_name(F.coalesce("name", F.lit("")))
    unnamed = F.when(form == "", F.array(F.lit("canonical_name must be non-empty"))).otherwise(F.array().cast("array<string>"))
    w = rows.select("ord", "type_key", "status", form.alias("form"), F.concat(unnamed, problems).alias("problems"))
    key = ["type_key", "form"]
    first = w.where("size(problems) = 0 AND status = 'active'").groupBy(*key).agg(F.min("ord").alias("first"))
    if active is not None:
        first = first.unionByName(active.select(*key).distinct().withColumn("first", F.lit(None).cast(rows.schema["ord"].dataType))).groupBy(*key).agg(F.when(F.count("first") < F.count("*"), None).otherwise(F.min("first")).alias("first"))
    found = w.join(first.withColumn("taken", F.lit(True)), key, "left")
    refused = F.coalesce(F.col("taken"), F.lit(False)) & (F.col("first").isNull() | (F.col("ord") > F.col("first")))
    return found.select("ord", "form", F.when(refused, F.array_append("problems", F.lit("active entity of this name exists"))).otherwise(F.col("problems")).alias("problems"))


def relation_shapes(rows: DataFrame, relation_types: DataFrame, constraints: DataFrame, *, unclear: str = "related_to", auto: str = "auto_active") -> DataFrame:
    """rows with valid, boundary_clear, requires_review and reasons.

    rows: relation, src_type, tgt_type; relation_types: relation, policy; constraints: relation, src_type, tgt_type,
    requires_review (one for each triple). Without a constraint for its ends a relation is invalid, but `unclear` is valid
    without a clear boundary; an unknown relation is invalid.
    """
    found = rows.join(constraints.withColumnRenamed("requires_review", "_review"), ["relation", "src_type", "tgt_type"], "left").join(relation_types.select("relation", F.col("policy").alias("_policy")), "relation", "left")
    there, known, loose = F.col("_review").isNotNull(), F.col("_policy").isNotNull(), F.col("relation") == unclear
    asks = F.coalesce("_policy", F.lit("")) != auto
    clear = scores.reasons((F.col("_review"), "relation type constraint requires review"), (loose, f"{unclear} requires review"), (asks, "relation type review policy requires review"))
    reasons = F.when(~known, F.array(F.lit("relation type is not active"))).when(there, clear).when(loose, F.array(F.lit(f"{unclear} schema boundary is unclear"))).otherwise(F.array(F.lit("active relation_type_constraint not found")))
    return found.select(*rows.columns, (known & (there | loose)).alias("valid"), (known & there).alias("boundary_clear"), (~known | ~there | F.col("_review") | loose | asks).alias("requires_review"), reasons.alias("reasons"))
