"""Streams over several batches, and a batch that runs again."""

from __future__ import annotations

from datetime import datetime, timedelta

from lodestone.streaming import events as ev

START = datetime(2024, 1, 1)


def source(spark, tmp_path, batches, schema):
    """A table of one file for each batch, read as a stream of one file a time."""
    folder = tmp_path / "events.parquet"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        newest = max(folder.glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
        newest.rename(folder / f"{k}-{newest.name}")
    return ev.stream(spark, str(tmp_path), "events", files_per_batch=1)


def test_fence_keeps_its_state_between_batches(spark, tmp_path):
    stream = source(spark, tmp_path, [[(1, 10, 1), (1, 11, 3), (2, 12, 1)], [(1, 13, 2), (1, 14, 4)], [(2, 15, 1), (3, 16, 9)]], "user long, row long, revision long")
    rows = ev.drained(ev.fenced(stream, "user", "revision", "row"), "fence").orderBy("row").collect()
    assert [(r["row"], r["current"], r["superseded"]) for r in rows] == [(10, 3, True), (11, 3, False), (12, 1, False), (13, 4, True), (14, 4, False), (15, 1, False), (16, 9, False)]


def test_outbox_without_repeats_over_batches(spark, tmp_path):
    at = [START + timedelta(minutes=k) for k in range(4)]
    stream = source(spark, tmp_path, [[("a", at[0]), ("a", at[1]), ("b", at[1])], [("a", at[2]), ("c", at[3])]], "key string, at timestamp")
    rows = ev.drained(ev.without_repeats(stream, ["key"], "at", "1 hour"), "outbox").collect()
    assert sorted(r["key"] for r in rows) == ["a", "b", "c"]


def test_windows_over_batches_and_late_rows(spark, tmp_path):
    day = timedelta(days=1)
    stream = source(spark, tmp_path, [[(START, "x", 1.0)], [(START + 5 * day, "x", 2.0), (START + timedelta(hours=1), "x", 4.0)], [(START + 5 * day, "x", 0.0)], [(START + timedelta(hours=2), "x", 8.0), (START + 5 * day, "x", 1.0)]], "ts timestamp, kind string, value double")
    rows = ev.latest(ev.drained(ev.windowed(stream, "ts", ["kind"], "6 hours", late="1 day"), "windows", "update"), ["window_start", "kind"]).orderBy("window_start").collect()
    assert [(r["n"], r["total"]) for r in rows] == [(2, 5.0), (3, 3.0)]  # the row that came days late is left out


def test_a_drained_folder_goes_on_where_it_stopped(spark, tmp_path):
    stream = source(spark, tmp_path, [[(1, 10, 1)]], "user long, row long, revision long")
    folder = f"{tmp_path}/out"
    first = ev.drained(stream.select("row"), "x", folder=folder)
    assert first.count() == 1
    spark.createDataFrame([(1, 11, 1)], "user long, row long, revision long").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    again = ev.drained(ev.stream(spark, str(tmp_path), "events", files_per_batch=1).select("row"), "x", folder=folder)
    assert sorted((r["row"], r["batch"]) for r in again.collect()) == [(10, 0), (11, 1)]


def test_change_feed(spark, tmp_path):
    stream = source(spark, tmp_path, [[(1, "upsert", "a", 1), (2, "upsert", "b", 1), (1, "upsert", "A", 2)], [(2, "delete", None, 3), (3, "upsert", "c", 3), (1, "upsert", None, 4)]], "id long, action string, text string, at long")
    table = {"now": spark.createDataFrame([(9, "old")], "id long, text string")}

    def write(df, number):
        path = f"{tmp_path}/table-{number}"
        df.write.mode("overwrite").parquet(path)
        table["now"] = df.sparkSession.read.parquet(path)

    ev.apply_changes(stream, lambda: table["now"], write, "id", "at", str(tmp_path / "feed"))
    assert sorted(map(tuple, table["now"].collect())) == [(1, "A"), (3, "c"), (9, "old")]


def test_sessions(spark):
    at = [START + timedelta(hours=h) for h in (0, 1, 5, 5)]
    rows = ev.sessions(spark.createDataFrame([(1, a) for a in at], "user long, ts timestamp"), "ts", "user", "2 hours").orderBy("session_start").collect()
    assert [(r["session_end"] - r["session_start"], r["n"]) for r in rows] == [(timedelta(hours=3), 2), (timedelta(hours=2), 2)]


def test_stream_static_join(spark, tmp_path):
    stream = source(spark, tmp_path, [[(1, 1)], [(2, 7)]], "row long, k long")
    table = spark.createDataFrame([(1, "one")], "k long, name string")
    assert sorted(map(tuple, ev.drained(ev.enriched(stream, table, "k", ["row", "name"]), "join").drop("batch").collect()), key=str) == [(1, "one"), (2, None)]
