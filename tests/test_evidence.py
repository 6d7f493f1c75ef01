"""A generation of evidence is whole or not there, and the same however often it is made."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from lodestone.operators import evidence


def made(spark, fail=False):
    docs = spark.createDataFrame([(1, 1, "h1", "one"), (2, 3, None, None), (3, 1, "h3", "no chunks"), (None, 1, "h", "no id")], "document_id long, revision_no int, content_hash string, title string").withColumn("id", F.lit("clash"))
    chunks = spark.createDataFrame([(1, 1, "h1", k, 10 * k, 10 * k + 9, f"text {k}") for k in range(40)] + [(2, 3, None, 0, None, None, None), (None, 1, "h", 0, 0, 1, "x")], "document_id long, revision_no int, content_hash string, seq int, source_start long, source_end long, text string").repartition(8)
    if fail:
        chunks = chunks.withColumn("text", F.when(F.col("seq") == 33, F.raise_error(F.lit("a task fails"))).otherwise(F.col("text")))
    return evidence.generation(docs, chunks)


def rows(spark, folder):
    return {k: sorted(map(tuple, df.collect()), key=str) for k, df in evidence.tables(spark, folder).items()}


def test_tables_and_ids(spark, tmp_path):
    folder = f"file://{tmp_path}/g"
    assert evidence.write(made(spark), folder)
    found = rows(spark, folder)
    assert {k: len(v) for k, v in found.items()} == {"revision": 3, "job": 3, "block": 41, "evidence": 41, "chunk": 41, "chunk_block": 41, "chunk_evidence": 41}
    revision = str(uuid.uuid5(uuid.NAMESPACE_URL, "revision:1:1:h1"))
    assert (revision, 1, "one", "h1", "pending") in found["revision"]
    assert any(r[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, f"chunk:{revision}:7")) and r[8:] == ("text 7", 6) for r in found["chunk"])
    assert all(r["orphans"] == 0 for r in evidence.orphans(evidence.tables(spark, folder)).collect())


def test_second_run_changes_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/g"
    evidence.write(made(spark), folder)
    before = sorted(p.name for p in (tmp_path / "g").rglob("*"))
    assert not evidence.write(made(spark), folder)
    assert sorted(p.name for p in (tmp_path / "g").rglob("*")) == before
    evidence.write(made(spark).repartition(3), f"file://{tmp_path}/h")
    assert rows(spark, folder) == rows(spark, f"file://{tmp_path}/h")


def test_a_failed_task_leaves_no_generation(spark, tmp_path):
    folder = f"file://{tmp_path}/g"
    with pytest.raises(Exception, match="a task fails"):
        evidence.write(made(spark, fail=True), folder)
    with pytest.raises(ValueError, match="no whole generation"):
        evidence.tables(spark, folder)
    assert evidence.write(made(spark), folder)
    assert len(rows(spark, folder)["chunk"]) == 41


def test_orphans_are_counted(spark, tmp_path):
    folder = f"file://{tmp_path}/g"
    evidence.write(made(spark), folder)
    found = evidence.tables(spark, folder)
    found["block"] = found["block"].where("seq <> 5")
    bad = {(r["kind"], r["reference"]): r["orphans"] for r in evidence.orphans(found).collect() if r["orphans"]}
    assert bad == {("evidence", "block_id"): 1, ("chunk", "block_id"): 1, ("chunk_block", "block_id"): 1}
