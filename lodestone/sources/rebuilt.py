"""Rebuilds in batches that survive a stop, and tables behind a pointer that is swapped once.

A rebuild has a folder of its own: the bounds of its batches, written first and never changed, and a folder for each batch,
whose job's commit says that it is done. So the cursor is what is there: a run that is started again does what is missing,
a batch that failed is done anew, and no batch twice. Only a rebuild that is whole can be pointed to.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _there(spark: SparkSession, path: str) -> bool:
    place, files = _files(spark, path)
    return files.exists(place)


def bounds(spark: SparkSession, folder: str, rows: DataFrame, key: str, batches: int) -> list[tuple[int, int | None]]:
    """First key and end of each batch (the last has none): about as many rows in each, as they were when the rebuild began. Fewer batches if keys are few; none of an empty table."""
    path = f"{folder}/bounds"
    if not _there(spark, f"{path}/_SUCCESS"):
        least, most = rows.agg(F.min(key), F.max(key)).first()
        cuts = rows.where(F.col(key).isNotNull()).approxQuantile(key, [k / batches for k in range(1, batches)], 0.001) if least is not None else []
        starts = sorted({int(least), *(int(c) + 1 for c in cuts if least < int(c) + 1 <= most)}) if least is not None else []
        spark.createDataFrame([(k,) for k in starts], "start long").coalesce(1).write.mode("overwrite").parquet(path)
    starts = sorted(r["start"] for r in spark.read.schema("start long").parquet(path).collect())  # as many as batches
    return list(zip(starts, [*starts[1:], None][: len(starts)], strict=True))


def progress(spark: SparkSession, folder: str) -> tuple[int, int]:
    """How many batches of a rebuild are done, and how many it has."""
    starts = spark.read.schema("start long").parquet(f"{folder}/bounds").count()
    return sum(_there(spark, f"{folder}/rows/batch={k}/_SUCCESS") for k in range(starts)), starts


def run(rows: DataFrame, key: str, build: Callable[[DataFrame], DataFrame], folder: str, *, batches: int = 16, most: int | None = None) -> int:
    """Does the batches of a rebuild that are missing (at most `most` of them) and returns how many it did. rows without a key take no part; rows that come while it runs belong to the batch of their key, if that is not done yet."""
    spark, done = rows.sparkSession, 0
    for k, (start, end) in enumerate(bounds(spark, folder, rows, key, batches)):
        path = f"{folder}/rows/batch={k}"
        if _there(spark, f"{path}/_SUCCESS"):
            continue
        if most is not None and done >= most:
            break
        inside = F.col(key) >= start if k else F.col(key).isNotNull()
        part = rows.where(inside if end is None else inside & (F.col(key) < end))
        build(part).write.mode("overwrite").parquet(path)
        done += 1
    return done


def publish(spark: SparkSession, folder: str, pointer: str) -> bool:
    """Points to a rebuild that is whole, in one step; false, and nothing changes, if it is not or is pointed to already."""
    done, total = progress(spark, folder)
    if done < total or pointed(spark, pointer) == folder:
        return False
    new, files = _files(spark, f"{pointer}-{uuid.uuid4().hex}")
    out = files.create(new, False)
    out.write(bytearray(folder.encode()))
    out.close()
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, _files(spark, pointer)[0], options)
    return True


def pointed(spark: SparkSession, pointer: str) -> str | None:
    """The folder that a pointer names."""
    return spark.read.text(pointer, wholetext=True).first()[0] if _there(spark, pointer) else None


def current(spark: SparkSession, pointer: str, schema: str) -> DataFrame:
    """The table that a pointer names."""
    folder = pointed(spark, pointer)
    if folder is None:
        raise ValueError(f"nothing is published at {pointer}")
    return spark.read.schema(schema).parquet(f"{folder}/rows/batch=*") if progress(spark, folder)[1] else spark.createDataFrame([], schema)
