"""The default ontology and the lookup of its rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The default types of entities and relations, and between which types each relation may stand.
ENTITY_TYPES = ("person", "department", "position", "policy", "process", "project", "product", "customer", "document", "term")
RELATION_TYPES = ("belongs_to", "reports_to", "responsible_for", "applies_to", "constrains", "references", "approves", "depends_on", "owns", "related_to")
#: relation, types at its source, types at its target, cardinality, whether it is always reviewed
RULES = (
    ("belongs_to", ("person", "position"), ("department",), "many_to_one", False),
    ("reports_to", ("person",), ("person",), "many_to_one", False),
    ("reports_to", ("position",), ("position",), "many_to_one", False),
    ("responsible_for", ("person", "department"), ("project", "process", "policy", "product"), "many_to_many", False),
    ("applies_to", ("policy",), ("department", "position", "person"), "one_to_many", False),
    ("constrains", ("policy",), ("process", "project"), "many_to_many", False),
    ("depends_on", ("process",), ("policy", "process"), "many_to_many", False),
    ("references", ("policy", "document"), ("policy", "document"), "many_to_many", False),
    ("approves", ("person", "position", "department"), ("process",), "many_to_many", False),
    ("owns", ("department",), ("product", "project"), "one_to_many", False),
    ("related_to", ENTITY_TYPES, ENTITY_TYPES, "many_to_many", True),
)


def constraints(spark: SparkSession) -> DataFrame:
    """relation, src_type, tgt_type, cardinality, requires_review: a row for each pair of types of each rule."""
    rules = spark.createDataFrame([(r, list(a), list(b), c, review) for r, a, b, c, review in RULES], "relation string, a array<string>, b array<string>, cardinality string, requires_review boolean")
    return rules.select("relation", F.explode("a").alias("src_type"), "b", "cardinality", "requires_review").select("relation", "src_type", F.explode("b").alias("tgt_type"), "cardinality", "requires_review")


def looked_up(facts: DataFrame) -> DataFrame:
    """facts (relation, src_type, tgt_type and more) with the constraint of their triple; nulls where there is none."""
    return facts.join(F.broadcast(constraints(facts.sparkSession)), ["relation", "src_type", "tgt_type"], "left")  # RULES, spelled out
