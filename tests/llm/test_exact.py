"""Exact duplicates against a plain version, odd rows, groups of many copies, and what the refinement hashes."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tests.conftest import SMALL
from lodestone.llm import exact, queries
from tests.llm.conftest import ODD, documents


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def plain(rows):
    """(doc_id, keep_id, group_size, sha256) of each row, and how many rows of each text stay: one."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[norm(text)].append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, keep[norm(t)], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows), key=str), len(groups)


def check(found, rows):
    got = found.collect()
    expected, n = plain(rows)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == expected
    kept = [r for r in got if r["kept"]]
    assert len(kept) == n == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_same_as_sql(spark, same_as_sql):
    same_as_sql(queries.op11_exact_dedup(spark, SMALL), queries.ORACLE_SQL["op11_exact_dedup"])


def test_odd_rows(spark, odd, empty):
    check(exact.duplicates(odd, digests=True), [(r[0], r[1]) for r in ODD])
    found = exact.duplicates(empty, digests=True)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and found.count() == 0


def test_blanks_are_one_space_and_others_are_not(spark):
    rows = [(1, "a b"), (2, "a \t\r\n\x0b\x0c b"), (3, " a b"), (4, "a b "), (5, "a\x1cb"), (6, "a　b"), (7, "a\xa0b"), (8, "ab"), (9, "  a b"), (10, ""), (11, None), (12, " "), (13, "\n\n")]
    check(exact.duplicates(documents(spark, rows), digests=True), rows)


def test_same_length_and_prefix_but_other_texts(spark):
    """Texts that differ behind the prefix, in the prefix only, and in their length only."""
    head = "x" * 300
    rows = [(k, head + f"{k % 5:03d}" + "y" * (k % 3)) for k in range(60)] + [(100 + k, f"{k % 4}" + head) for k in range(12)] + [(200, "é" * 10), (201, "e" * 20), (202, "é" * 10)]
    docs = documents(spark, rows)
    for prefix in (1, 128, 10_000):
        check(exact.duplicates(docs, prefix=prefix, digests=True), rows)


def test_one_text_fills_most_rows(spark):
    """Two rows in three are copies of one text, some of them under one id; partitions lie as they will."""
    rows = [(k if k % 2 else 5, "the same  text\nover and over") for k in range(2_000)] + [(5_000 + k, f"text {k % 700}") for k in range(1_000)] + [(None, "no id"), (None, "no id"), (9_000, None), (None, "")]
    check(exact.duplicates(documents(spark, rows).repartition(13), digests=True), rows)


def test_only_texts_that_share_length_and_prefix_are_hashed(spark):
    rows = [(k, f"{k:05d} differs at once") for k in range(500)] + [(k, "as long as the others!") for k in (600, 601)] + [(700, "alone in its length")]
    found = exact.duplicates(documents(spark, rows))
    hashed = {r["doc_id"] for r in found.where("text_sha256 IS NOT NULL").collect()}
    assert {600, 601} <= hashed and len(hashed) < 20
    assert found.where(F.col("doc_id") == 601).select("keep_id", "group_size", "kept").first() == (600, 2, False)


def test_very_long_texts(spark):
    long = "many words and more " * 400_000
    rows = [(1, long + "a"), (2, long + "b"), (3, long.replace(" ", "\n\t") + "a"), (4, "short")]
    check(exact.duplicates(documents(spark, rows), digests=True), rows)
