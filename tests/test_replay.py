"""Outcomes of replayed occurrences against a plain version, over several batches."""

from __future__ import annotations

import random

from lodestone.streaming import replay as rp

ROW = "unit long, ordinal int, kind string, source string, target string, seq long"


def plain(batches: list[list[tuple]]) -> list[tuple]:
    held, out = {}, []
    for n, rows in enumerate(batches):
        last = lambda x: (x is None, x or "")
        for unit, ordinal, kind, source, target, seq in sorted((r for r in rows if None not in (r[0], r[1], r[5])), key=lambda r: (*r[:2], r[5], r[2], last(r[3]), last(r[4]))):
            known, ends = held.get((unit, ordinal)), (source, target)
            if known is None:
                told = "purge_of_unknown" if kind == "purge" else "created"
                if kind != "purge":
                    known = held[unit, ordinal] = {"ends": ends, "purged": False, "told": set()}
            elif kind == "purge":
                known["purged"], told = True, "purged"
            elif known["purged"]:
                told = "error_purged"
            elif ends == known["ends"]:
                told = "replayed"
            else:
                told = "conflict_known" if ends in known["told"] else "conflict_opened"
                known["told"].add(ends)
            out.append((unit, ordinal, seq, source, target, told, *(known["ends"] if known else (None, None)), n))
    return sorted(out, key=str)


def test_outcomes_same_as_row_by_row_and_no_python_in_the_plan(spark, tmp_path):
    rng = random.Random(6)
    some = lambda n: rng.choice([None, *[f"S{k}" for k in range(n)]])
    row = lambda: (rng.choice([None, *range(12)]), rng.randrange(3), *(("purge", None, None) if rng.random() < 0.12 else ("occurrence", some(2), some(2))), rng.randrange(5))
    batches = [[row() for _ in range(n)] for n in (40, 90, 0, 60)]
    batches[0].append((1, None, "occurrence", "a", "b", 1))
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, ROW).repartition(3).write.parquet(f"{tmp_path}/in/{n}")
        found = rp.replayed(spark.readStream.schema(ROW).parquet(f"{tmp_path}/in/*"), str(tmp_path / "out"))
    got = [tuple(r) for r in found.collect()]
    number = {b: k for k, b in enumerate(sorted({r[-1] for r in got}))}
    want = plain([b for b in batches if b])
    assert sorted(((*r[:-1], number[r[-1]]) for r in got), key=str) == want
    assert {r[5] for r in want} == {"created", "purged", "purge_of_unknown", "error_purged", "replayed", "conflict_opened", "conflict_known"}
    held = spark.createDataFrame([], rp.HELD)
    assert "Python" not in rp.outcomes(spark.createDataFrame(batches[0], ROW), held)._jdf.queryExecution().toString()
