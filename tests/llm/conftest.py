"""Documents with what may be odd about them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHING = ("score", "held_out", "predicted", "n", "h1", "h2", "rep", "signature", "component", "key", "bucket", "salt", "nth", "payload", "digest", "shard", "kept", "Doc", "size", "is_p")


def documents(spark, rows):
    """documents of (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "made", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "many words in a row " * 8000), (None, "a row without an id"), (None, None),
    (7, "the same row twice over and over"), (7, "the same row twice over and over"), (7, "another text of one id"), (8, "Ünïcödé ÄÖ ß 日本語 　 é \x1c end"),
    (9, "x" * 100_000), (10, "1234 5678 !!! ..."), (11, "the same row twice over and over"), (-3, "a negative id has a row"),
]


@pytest.fixture
def odd(spark):
    df = documents(spark, ODD)
    for name in CLASHING:
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture
def empty(spark):
    return documents(spark, [])
