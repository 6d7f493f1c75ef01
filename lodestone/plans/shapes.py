"""Queries of shape validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import shapes
from lodestone.operators.shapes import Attribute, Shape
from lodestone.plans.catalog import query
from lodestone.sources.tables import Tables

#: What types of events, taken as entity types, ask of their properties.
SHAPES = {
    "signup": Shape(("k",), {"k": {"type": "integer"}}, (Attribute("since", "datetime", True), Attribute("level", "enum", False, ["low", "high"]))),
    "view": Shape((), {"k": {"type": ["integer", "string"]}, "level": {"enum": ["low", "high", 3]}}, (Attribute("day", "date"), Attribute("flag", "boolean"))),
    "purchase": Shape(("k", "level"), {"k": {"type": "number"}, "more": {"type": "object"}}, (Attribute("k", "integer", True), Attribute("level", "text"), Attribute("more", "json"))),
    "error": Shape((), {"flag": {"type": "null"}, "more": {"type": "array"}}, (Attribute("k", "number"),)),
}
#: Properties by the event's number modulo nine; K stands for what its own properties hold, D for its day.
PROPS = (
    '{"k":K,"since":"DT10:00:00Z","level":"low"}', '{"k":"K","day":"D","flag":true}', '{"k":K.5,"level":"high","more":{"a":[K]}}', '{"level":3,"flag":null,"more":[1,K]}', '{"k":K,"since":"D 25:00:00","level":"mid"}',
    '{"k":null,"day":"2024-02-30","flag":"yes"}', '[K]', '{"k":true,"level":["low"],"more":"none","since":"D"}', '{"k":K,"level":"low","day":"20240229"',
)


def _writes(t: Tables) -> DataFrame:
    """Events as writes of entities: a few names for each type, every third one asked to be active."""
    template = F.element_at(F.array(*map(F.lit, PROPS)), (F.col("event_id") % 9 + 1).cast("int"))
    props = F.replace(F.replace(template, F.lit("K"), F.get_json_object("props", "$.k")), F.lit("D"), F.date_format("ts", "yyyy-MM-dd"))
    name = F.when(F.col("event_id") % 50 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" User  "), (F.col("user_id") % 40).cast("string")))
    return t.events.select(F.col("event_id").alias("ord"), F.col("event_type").alias("type_key"), name.alias("name"), F.when(F.col("event_id") % 11 != 0, props).alias("props"), F.when(F.col("event_id") % 3 == 0, "active").otherwise("draft").alias("status"))


_RULES = {
    # type -> condition and what is said, in order; t(x): the JSON type of a value, j: the properties
    "signup": [("missing('k')", "missing required property: k"), ("has('k') AND t('k') NOT IN ('UBIGINT', 'BIGINT')", "property k must match schema type integer"), ("missing('since')", "missing required attribute: since"),
               ("has('since') AND NOT moment(s('since'))", "attribute since must be datetime"), ("has('level') AND NOT coalesce(t('level') = 'VARCHAR' AND s('level') IN ('low', 'high'), false)", "attribute level must be one of ['low', 'high']")],
    "view": [("has('k') AND t('k') NOT IN ('UBIGINT', 'BIGINT', 'VARCHAR')", "property k must match schema type ['integer', 'string']"), ("has('level') AND NOT coalesce((t('level') = 'VARCHAR' AND s('level') IN ('low', 'high')) OR (t('level') = 'UBIGINT' AND s('level') = '3'), false)", "property level must be one of ['low', 'high', 3]"),
             ("has('day') AND NOT coalesce(try_cast(regexp_replace(s('day'), '^(\\d{4})(\\d{2})(\\d{2})$', '\\1-\\2-\\3') AS DATE) IS NOT NULL, false)", "attribute day must be date"), ("has('flag') AND t('flag') <> 'BOOLEAN'", "attribute flag must be boolean")],
    "purchase": [("missing('k')", "missing required property: k"), ("missing('level')", "missing required property: level"), ("has('k') AND t('k') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE')", "property k must match schema type number"), ("has('more') AND t('more') <> 'OBJECT'", "property more must match schema type object"),
                 ("missing('k')", "missing required attribute: k"), ("has('k') AND t('k') NOT IN ('UBIGINT', 'BIGINT')", "attribute k must be integer"), ("has('level') AND t('level') <> 'VARCHAR'", "attribute level must be text")],
    "error": [("has('flag') AND t('flag') <> 'NULL'", "property flag must match schema type null"), ("has('more') AND t('more') <> 'ARRAY'", "property more must match schema type array"), ("has('k') AND t('k') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE')", "attribute k must be number")],
}


def _said(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _problems_sql() -> str:
    out = ["CASE WHEN NOT ok THEN 'properties must be an object' END"]
    for kind, rules in _RULES.items():
        for condition, what in rules:
            c = condition
            for name in ("k", "since", "level", "day", "flag", "more"):
                c = c.replace(f"missing('{name}')", f"json_type(j, '$.{name}') IS NULL").replace(f"has('{name}')", f"json_type(j, '$.{name}') IS NOT NULL").replace(f"t('{name}')", f"json_type(j, '$.{name}')").replace(f"s('{name}')", f"json_extract_string(j, '$.{name}')")
            c = c.replace("moment(json_extract_string(j, '$.since'))", "coalesce(try_cast(json_extract_string(j, '$.since') AS TIMESTAMPTZ) IS NOT NULL, false)")
            out.append(f"CASE WHEN ok AND type_key = '{kind}' AND {c} THEN {_said(what)} END")
    return "[" + ", ".join(out) + "]"


@query(
    f"""WITH w AS (SELECT event_id AS ord, event_type AS type_key, CASE WHEN event_id % 50 = 0 THEN '  ' ELSE ' User  ' || (user_id % 40) END AS name, CASE WHEN event_id % 3 = 0 THEN 'active' ELSE 'draft' END AS status,
        CASE WHEN event_id % 11 <> 0 THEN replace(replace([{", ".join(map(_said, PROPS))}][event_id % 9 + 1], 'K', json_extract_string(props, '$.k')), 'D', strftime(ts, '%Y-%m-%d')) ELSE '{{}}' END AS props FROM events),
    p AS (SELECT *, coalesce(json_valid(props), false) AS fine, CASE WHEN json_valid(props) THEN props::JSON END AS j, trim(regexp_replace(lower(name), '[ \\t\\n\\r]+', ' ', 'g')) AS form FROM w), o AS (SELECT *, fine AND coalesce(json_type(j) = 'OBJECT', false) AS ok FROM p),
    v AS (SELECT *, list_concat(CASE WHEN form = '' THEN ['canonical_name must be non-empty'] ELSE [] END, CASE WHEN type_key IN ({", ".join(map(_said, SHAPES))}) THEN [x FOR x IN {_problems_sql()} IF x IS NOT NULL] ELSE ['entity type is not active'] END) AS found FROM o),
    f AS (SELECT type_key, form, min(ord) AS first_ FROM v WHERE len(found) = 0 AND status = 'active' GROUP BY ALL)
    SELECT ord, form, CASE WHEN ord > first_ THEN list_append(found, 'active entity of this name exists') ELSE found END AS problems FROM v LEFT JOIN f USING (type_key, form)"""
)
def graph_entity_shapes(t: Tables) -> DataFrame:
    """DOM-20: names, properties against schema and attribute rules, and a second active entity of one name refused."""
    return shapes.entity_writes(_writes(t), SHAPES)


_POLICIES = [("belongs_to", "auto_active"), ("supplies", "review_required"), ("related_to", "auto_active")]
_ALLOWED = [("belongs_to", "nation", "region", False), ("belongs_to", "supplier", "nation", True), ("supplies", "supplier", "part", False), ("related_to", "customer", "part", True)]


@query(
    f"""WITH r(relation, policy) AS (VALUES {", ".join(map(str, _POLICIES))}), c(relation, src_type, tgt_type, review) AS (VALUES {", ".join(map(str, _ALLOWED)).replace("False", "false").replace("True", "true")}),
    e AS (SELECT CASE WHEN relation = 'owns' AND right(tgt, 1) IN ('1', '2') THEN 'related_to' ELSE relation END AS relation, src, tgt, CASE WHEN right(src, 1) = '9' THEN 'part' ELSE a.type_key END AS src_type, b.type_key AS tgt_type FROM edges_v JOIN nodes_v a ON a.node_id = src JOIN nodes_v b ON b.node_id = tgt)
    SELECT relation, src, tgt, src_type, tgt_type, policy IS NOT NULL AND (review IS NOT NULL OR relation = 'related_to') AS valid, policy IS NOT NULL AND review IS NOT NULL AS boundary_clear, policy IS NULL OR review IS NULL OR review OR relation = 'related_to' OR policy <> 'auto_active' AS requires_review,
        CASE WHEN policy IS NULL THEN ['relation type is not active'] WHEN review IS NOT NULL THEN [x FOR x IN [CASE WHEN review THEN 'relation type constraint requires review' END, CASE WHEN relation = 'related_to' THEN 'related_to requires review' END, CASE WHEN policy <> 'auto_active' THEN 'relation type review policy requires review' END] IF x IS NOT NULL]
            WHEN relation = 'related_to' THEN ['related_to schema boundary is unclear'] ELSE ['active relation_type_constraint not found'] END AS reasons FROM e LEFT JOIN r USING (relation) LEFT JOIN c USING (relation, src_type, tgt_type)""",
    views="nodes_v edges_v",
)
def graph_relation_shapes(t: Tables) -> DataFrame:
    """DOM-20: relations against the constraints of their types and ends."""
    ends = t.nodes_v.select("node_id", "type_key")
    e = t.edges_v.join(ends.toDF("src", "src_type"), "src").join(ends.toDF("tgt", "tgt_type"), "tgt")
    relation = F.when((F.col("relation") == "owns") & F.right("tgt", F.lit(1)).isin("1", "2"), "related_to").otherwise(F.col("relation"))
    rows = e.select(relation.alias("relation"), "src", "tgt", F.when(F.right("src", F.lit(1)) == "9", "part").otherwise(F.col("src_type")).alias("src_type"), "tgt_type")
    types = t.spark.createDataFrame(_POLICIES, "relation string, policy string")
    return shapes.relation_shapes(rows, F.broadcast(types), F.broadcast(t.spark.createDataFrame(_ALLOWED, "relation string, src_type string, tgt_type string, requires_review boolean")))
