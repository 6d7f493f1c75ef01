"""Scores, routes, hashes and limits as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def content_hash(x: Column) -> Column:
    return F.sha2(x, 256)


def canonical(**fields: Column) -> Column:
    """Compact JSON of the fields by name, numbers given as text."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def value_hash(**fields: Column) -> Column:
    return F.sha2(canonical(**fields), 256)


def uuid5(namespace: bytes, name: Column) -> Column:
    """The version 5 UUID of a name."""
    h = F.sha1(F.concat(F.lit(namespace), name.cast("binary")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def weighted_confidence(model: Column, evidence: Column, schema: Column, normalisation: Column) -> Column:
    return model * 0.25 + evidence * 0.35 + schema * 0.25 + normalisation * 0.15


def rounded(x: Column, digits: int = 9) -> Column:
    return F.round(x, digits)


def progress(done: Column, expected: Column) -> Column:
    return F.when(expected > 0, F.round(100.0 * done / expected, 1)).otherwise(F.lit(0.0))


def backoff(attempt: Column, base: float, cap: float) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), (attempt - 1).cast("double")), F.lit(float(cap)))


def latency_ceiling(p95: Column, hard: int = 2_400_000) -> Column:
    """The greater of p95 and a quarter more, rounded up, and 5000 more; at most `hard`."""
    return F.least(F.greatest(F.ceil(p95 * 1.25), p95 + 5000), F.lit(hard)).cast("long")


def clamped(x: Column, kind: str = "int") -> Column:
    """A number from text, null if it is none or out of the type's range."""
    return x.try_cast(kind)


def first_of(*rules: tuple[Column, str], otherwise: str) -> Column:
    """The name of the first rule that holds."""
    out = F.lit(otherwise)
    for condition, name in reversed(rules):
        out = F.when(condition, name).otherwise(out)
    return out


def reasons(*rules: tuple[Column, str]) -> Column:
    """The names of all rules that hold, in order."""
    return F.filter(F.array(*[F.when(c, n) for c, n in rules]), lambda r: r.isNotNull())
