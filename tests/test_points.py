"""The point sink: batches that fail leave nothing, batches that come again change nothing."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.sources import points


def frame(spark, rows):
    return spark.createDataFrame(rows, "document_id long, revision long, point_id string, payload string").withColumn("batch", F.lit("clash")).repartition(4)


def found(spark, folder):
    return sorted(map(tuple, points.current(spark, folder).collect()))


def test_upserts_and_deletes(spark, tmp_path):
    folder = f"file://{tmp_path}/p"
    assert found(spark, folder) == []
    points.write(frame(spark, [(d, 1, f"{d}-{k}", "a") for d in range(20) for k in range(5)] + [(None, 1, "x", "a"), (3, None, "x", "a")]), folder, "b1")
    points.write(frame(spark, [(1, 2, "1-0", "new"), (2, 1, "2-3", "changed"), (2, 1, "2-9", None), (4, 2, None, None), (5, 0, "5-0", "late")]), folder, "b2")
    expected = [(d, 1, f"{d}-{k}", "changed" if (d, k) == (2, 3) else "a") for d in range(20) if d not in (1, 4) for k in range(5)] + [(1, 2, "1-0", "new"), (2, 1, "2-9", None)]
    assert found(spark, folder) == sorted(expected)
    assert sorted(r["batch"] for r in points.committed(spark, folder).collect()) == ["b1", "b2"]


def test_the_same_batch_again_changes_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/p"
    rows = frame(spark, [(1, 1, "a", "x"), (2, 1, "b", "y")])
    points.write(rows, folder, "b1")
    files, before = sorted(p.name for p in (tmp_path / "p").rglob("*")), found(spark, folder)
    points.write(rows, folder, "b1")
    points.write(frame(spark, [(9, 9, "other", "rows")]), folder, "b1")
    assert sorted(p.name for p in (tmp_path / "p").rglob("*")) == files and found(spark, folder) == before


def test_a_failed_batch_leaves_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/p"
    points.write(frame(spark, [(1, 1, "a", "x")]), folder, "b1")
    bad = frame(spark, [(d, 2, "a", "z") for d in range(400)]).withColumn("payload", F.when(F.col("document_id") == 399, F.raise_error(F.lit("a task fails"))).otherwise("z"))
    with pytest.raises(Exception, match="a task fails"):
        points.write(bad, folder, "b2")
    assert found(spark, folder) == [(1, 1, "a", "x")] and points.committed(spark, folder).count() == 1
    points.write(frame(spark, [(d, 2, "a", "z") for d in range(400)]), folder, "b2")
    assert len(found(spark, folder)) == 400
    named = {f for r in points.committed(spark, folder).collect() for f in r["files"]}
    assert {f"files/{p.name}" for p in (tmp_path / "p/files").glob("*.parquet")} == named


def test_names_of_batches(spark, tmp_path):
    for name in ("", "a/b", "../x"):
        with pytest.raises(Exception, match="batch that has a name"):
            points.write(frame(spark, [(1, 1, "a", "x")]), f"file://{tmp_path}/p", name)
    points.write(frame(spark, []), f"file://{tmp_path}/p", "empty")
    assert found(spark, f"file://{tmp_path}/p") == []
