"""JSON of any depth as columns: its canonical form, its digest, and its nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control characters without a short escape whose number has a letter: canonical JSON writes it small.
ESCAPES = [f"{c:04X}" for c in range(32) if f"{c:04X}" != f"{c:04x}" and c not in (10, 12, 13)]


def canonical_json(x: Column) -> Column:
    """JSON text in canonical form: keys in order at every depth, nothing between tokens, all but control characters, quotes and backslashes as they are; null if it is no JSON or says a key twice.

    A variant holds an object's fields in the order of their names, so parsing puts them in order. Numbers are written as
    the variant holds them: 1.50 as 1.5, and 1.0 as 1.
    """
    plain = out = F.to_json(F.try_parse_json(x))
    for code in ESCAPES:
        out = F.regexp_replace(out, f"(?<!\\\\)((?:\\\\\\\\)*)\\\\u{code}", f"$1\\\\u{code.lower()}")
    return F.when(F.contains(plain, F.lit("\\u")), out).otherwise(plain)  # hardly any text has such an escape, and the patterns are dear


def json_hash(x: Column) -> Column:
    return F.sha2(canonical_json(x), 256)


def nodes(rows: DataFrame, key: str, json: str, depth: int = 8) -> DataFrame:
    """key, path, name (in its object; null in an array and at the top), value (a variant), level and open (whether more lies below, past `depth`) of every node of a column of JSON text.

    Each level is exploded where its row is, so that one pass without a shuffle finds all. Text that is no JSON has no nodes.
    """
    out = rows.select(key, F.lit("$").alias("path"), F.lit(None).cast("string").alias("name"), F.try_parse_json(json).alias("value"), F.lit(0).alias("level")).where("value IS NOT NULL")
    node = "struct<path: string, name: string, value: variant, level: int>"
    fields, items = F.try_variant_get("value", "$", "map<string, variant>"), F.try_variant_get("value", "$", "array<variant>")
    for level in range(depth):
        child = lambda path, name, value, n=level: F.struct(path.alias("path"), name.alias("name"), value.alias("value"), F.lit(n + 1).alias("level"))
        inside = F.transform(F.map_entries(fields), lambda e: child(F.concat("path", F.lit("."), e["key"]), e["key"], e["value"]))
        listed = F.transform(items, lambda v, i: child(F.concat(F.col("path"), F.lit("["), i.cast("string"), F.lit("]")), F.lit(None).cast("string"), v))
        below = F.when(F.col("level") == level, F.coalesce(inside, listed))
        own = F.array(F.struct("path", "name", "value", "level").cast(node))
        out = out.select(key, F.inline(F.concat(own, F.coalesce(below.cast(f"array<{node}>"), F.array().cast(f"array<{node}>")))))
    more = (F.coalesce(F.size(F.map_keys(fields)), F.lit(0)) > 0) | (F.coalesce(F.size(items), F.lit(0)) > 0)
    return out.withColumn("open", (F.col("level") == depth) & more)
