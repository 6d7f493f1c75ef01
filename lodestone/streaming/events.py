"""Streams of work: an outbox without repeats, fencing by revision, a change feed, and windows over event time.

`drained` runs a stream until its source is read (trigger availableNow) and returns what it has written; each batch has a
folder of its own, so that a batch that is run again replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql import types as T

from lodestone.operators import lifecycle
from lodestone.sources.shared import shared


def stream(spark: SparkSession, sf_dir: str, name: str, *, files_per_batch: int | None = None) -> DataFrame:
    """A table of the folder as a stream, with the schema that a batch read finds."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern: the source takes folders and patterns, and this one matches the table alone


def drained(df: DataFrame, name: str, mode: str = "append", *, folder: str | None = None) -> DataFrame:
    """The rows that a stream writes until its source is read, and `batch`, the number of the batch."""
    spark = df.sparkSession
    folder = folder or shared(spark, name)

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return written(spark, folder, df.schema)


def written(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The rows of a stream's batches, each in a folder of its own under rows, and `batch`."""
    schema = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows/batch=*") if any_written(spark, folder) else spark.createDataFrame([], schema)


def any_written(spark: SparkSession, folder: str) -> bool:
    """Whether a stream has written any batch."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Of a stream drained in update mode, the last state of each key."""
    return lifecycle.newest(updates, keys, ["batch"]).drop("batch")


def without_repeats(events: DataFrame, key: list[str], at: str, late: str = "1 day") -> DataFrame:
    """The first event of each idempotency key; a key is forgotten once the watermark is past it."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def fenced(events: DataFrame, key: str, revision: str, row_id: str) -> DataFrame:
    """key, row_id, current (the key's highest revision so far) and superseded of each event: whether a newer revision of its key had come by the end of its batch.

    The state of a key is its highest revision alone.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(frames)
        rows = pd.concat(held) if held else pd.DataFrame({row_id: [], "revision": []})
        top = max(state.get[0] if state.exists else rows["revision"].max(), rows["revision"].max())
        state.update((int(top),))
        yield pd.DataFrame({key: k[0], row_id: rows[row_id], "current": int(top), "superseded": rows["revision"] < top})

    schema = f"{key} long, {row_id} long, current long, superseded boolean"
    source = events.select(F.col(key).cast("long").alias(key), F.col(row_id).cast("long").alias(row_id), F.col(revision).cast("long").alias("revision"))
    return source.groupBy(key).applyInPandasWithState(run, schema, "top long", "append", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, at: str, by: list[str], length: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """window_start, by and n: tumbling windows, or sliding ones if slide is given."""
    window = F.window(at, length, slide) if slide else F.window(at, length)
    counted = events.withWatermark(at, late).groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, at: str, key: str, gap: str, late: str = "1 day") -> DataFrame:
    """key, session_start, session_end (the last event and the gap) and n."""
    counted = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("s"), key).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def enriched(events: DataFrame, table: DataFrame, on: str, columns: list[str | Column]) -> DataFrame:
    """A stream beside a table, read anew in each batch."""
    return events.join(table, on, "left").select(*columns)


def apply_changes(changes: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], key: str, order: str, folder: str) -> None:
    """A stream of upserts and deletes (`action`), applied batch by batch to the table that read gives and write replaces; the last change of a key in a batch counts."""

    def batch(rows: DataFrame, number: int) -> None:
        write(lifecycle.merged(read(), lifecycle.newest(rows, [key], [order]).drop(order), key), number)

    changes.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
