"""Rebuilds that are stopped, fail and are resumed; a pointer that names whole ones only."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.sources import rebuilt

SCHEMA = "id long, value string"


def rows(spark, n=300, extra=()):
    return spark.createDataFrame([(k * 3, f"v{k}") for k in range(n)] + [(5, "again"), (5, "again"), (None, "no key"), *extra], SCHEMA).repartition(4)


def build(label, fail_from=None):
    def run(part):
        value = F.concat(F.lit(label), "value")
        if fail_from is not None:
            value = F.when(F.col("id") >= fail_from, F.raise_error(F.lit("killed"))).otherwise(value)
        return part.select("id", value.alias("value"))

    return run


def test_the_second_of_three_batches_is_killed(spark, tmp_path):
    folder, pointer, source = f"file://{tmp_path}/a", f"file://{tmp_path}/current", rows(spark)
    with pytest.raises(Exception, match="killed"):
        rebuilt.run(source, "id", build("a-", fail_from=400), folder, batches=3)
    assert rebuilt.progress(spark, folder) == (1, 3)
    first = (tmp_path / "a/rows/batch=0/_SUCCESS").stat().st_mtime_ns
    assert not rebuilt.publish(spark, folder, pointer) and rebuilt.pointed(spark, pointer) is None
    with pytest.raises(ValueError, match="nothing is published"):
        rebuilt.current(spark, pointer, SCHEMA)
    assert rebuilt.run(source, "id", build("a-"), folder, batches=99) == 2
    assert (tmp_path / "a/rows/batch=0/_SUCCESS").stat().st_mtime_ns == first
    assert rebuilt.publish(spark, folder, pointer) and not rebuilt.publish(spark, folder, pointer)
    expected = sorted((r["id"], "a-" + r["value"]) for r in source.collect() if r["id"] is not None)
    assert sorted(map(tuple, rebuilt.current(spark, pointer, SCHEMA).collect())) == expected
    assert rebuilt.run(source, "id", build("other-"), folder) == 0


def test_the_old_table_is_read_until_the_new_one_is_whole(spark, tmp_path):
    pointer = f"file://{tmp_path}/current"
    old, new = f"file://{tmp_path}/old", f"file://{tmp_path}/new"
    rebuilt.run(rows(spark, 20), "id", build("old-"), old, batches=2)
    rebuilt.publish(spark, old, pointer)
    later = rows(spark, 30, extra=[(-7, "earlier"), (10_000, "later")])
    while rebuilt.run(later, "id", build("new-"), new, batches=4, most=1):
        if not rebuilt.publish(spark, new, pointer):
            assert {r["value"][:4] for r in rebuilt.current(spark, pointer, SCHEMA).collect()} == {"old-"}
    found = rebuilt.current(spark, pointer, SCHEMA)
    assert found.count() == 34 and {r["value"][:4] for r in found.collect()} == {"new-"}
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("current")] == ["current"]


def test_nothing_and_one_key(spark, tmp_path):
    empty = f"file://{tmp_path}/empty"
    assert rebuilt.run(rows(spark).where("false"), "id", build(""), empty) == 0
    assert rebuilt.publish(spark, empty, f"file://{tmp_path}/p") and rebuilt.current(spark, f"file://{tmp_path}/p", SCHEMA).collect() == []
    one = f"file://{tmp_path}/one"
    assert rebuilt.run(rows(spark).where("id = 5"), "id", build(""), one, batches=8) == 1
    assert rebuilt.progress(spark, one) == (1, 1)
