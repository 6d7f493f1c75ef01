"""Replays in parts of a batch, by notices, after a batch without news; and what they leave on disk."""

from __future__ import annotations

import os
import random

from lodestone.sources.shared import shared
from lodestone.streaming import replay as rp
from tests.conftest import SMALL
from tests.test_replay import ROW, plain


def test_parts_and_notices_give_the_outcomes_of_row_by_row(spark, tmp_path):
    rng = random.Random(11)
    ends = lambda: rng.choice([None, "S0", "S1"])
    row = lambda: (rng.randrange(20), rng.randrange(3), *(("purge", None, None) if rng.random() < 0.1 else ("occurrence", ends(), ends())), rng.randrange(5))
    batches = [[(90, 1, "purge", None, None, 1)], *[[row() for _ in range(n)] for n in (60, 120, 80)]]
    for n in range(len(batches)):
        spark.createDataFrame([(n,)], "delivery int").write.parquet(f"{tmp_path}/in/{n}")
        taken = lambda notices: notices.sparkSession.createDataFrame([x for r in notices.collect() for x in batches[r["delivery"]]], ROW)
        found = rp.replayed(spark.readStream.schema("delivery int").parquet(f"{tmp_path}/in/*"), str(tmp_path / "out"), taken, at_once=25)
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(batches)


def test_nothing_but_outcomes_and_notices_is_kept(spark):
    """A delivery is read where it lies, and what is held is no table beside the outcomes."""
    from lodestone import plans

    folder = shared(spark, "x").rsplit("/", 1)[0].removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    plans.QUERIES["stream_endpoint_replay"](spark, SMALL)
    (made,) = set(os.listdir(folder)) - before
    kept = {d: sum(os.path.getsize(os.path.join(p, f)) for p, _, files in os.walk(f"{folder}/{made}/{d}") for f in files) for d in os.listdir(f"{folder}/{made}")}
    assert set(kept) == {"in", "checkpoint", "rows"}
    assert kept["in"] < 20_000 < kept["rows"]
