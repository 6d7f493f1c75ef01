"""What must not be in the records that are kept of requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import nested

#: Names of what is private.
PRIVATE = ("properties", "canonical_name", "seed_name", "source_text", "request_body", "sql", "exception")


def offences(records: DataFrame, key: str, json: str, *, allowed: Sequence[str], forbidden: Sequence[str] = (), private: Sequence[str] = PRIVATE, depth: int = 8) -> DataFrame:
    """key, path, offence: every place of a record (JSON text) that offends; none for a record that is clean.

    Offences: "not an object" ($), "unexpected field" and "missing field" against `allowed` (names of the top), "private
    field" (a name, or a text that is nothing else, in `private`), "private marker" (a name or value that holds one of
    `forbidden`), both whatever the case and at any depth, and "too deep" where more lies below `depth`.
    """
    found = nested.nodes(records, key, json, depth)
    text = F.lower(F.coalesce(F.when(F.schema_of_variant("value") == "STRING", F.try_variant_get("value", "$", "string")), F.when(~F.startswith(F.schema_of_variant("value"), F.lit("OBJECT")) & ~F.startswith(F.schema_of_variant("value"), F.lit("ARRAY")), F.to_json("value")), F.lit("")))
    name, top = F.lower(F.coalesce("name", F.lit(""))), (F.col("level") == 1) & F.col("name").isNotNull()
    held = F.lit(False)
    for marker in forbidden:
        if marker:
            held = held | F.contains(text, F.lit(marker.lower())) | F.contains(name, F.lit(marker.lower()))
    rules = ((top & ~F.col("name").isin(*allowed), "unexpected field"), (name.isin(*private) | text.isin(*private), "private field"), (held, "private marker"), (F.col("open"), "too deep"))
    kinds = F.filter(F.array(*[F.when(rule, what) for rule, what in rules]), lambda x: x.isNotNull())
    inside = found.select(key, "path", F.explode(kinds).alias("offence"))
    parsed = F.try_variant_get(F.try_parse_json(json), "$", "map<string, variant>")
    missing = F.transform(F.array_except(F.array(*map(F.lit, allowed)), F.map_keys(parsed)), lambda n: F.struct(F.concat(F.lit("$."), n).alias("path"), F.lit("missing field").alias("offence")))
    whole = F.array(F.struct(F.lit("$").alias("path"), F.lit("not an object").alias("offence")))
    outside = records.select(key, F.inline(F.when(parsed.isNull(), whole).otherwise(missing)))
    return inside.unionByName(outside)
