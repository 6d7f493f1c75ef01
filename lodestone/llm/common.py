"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a new local one, but only if all run on this machine."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table in the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = out, path
    return out


_paths: dict[int, tuple[DataFrame, str]] = {}


def drop(*tables: DataFrame) -> None:
    """Deletes tables that `saved` has written. Nothing that is still to be computed may come from them."""
    for df in tables:
        _, path = _paths.pop(id(df))
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


BITS = 1 << 26


def among(rows: DataFrame, key: str, need: DataFrame, inside: bool = True) -> DataFrame:
    """The rows whose key is in need's only column, and a few others: as many as share one of BITS bits with one that is. inside: false for all other rows."""
    bit = F.pmod(F.xxhash64(need.columns[0]), F.lit(BITS)) + 1
    maps = need.groupBy(F.bitmap_bucket_number(bit).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_bits"))
    own = F.pmod(F.xxhash64(key), F.lit(BITS)) + 1
    byte = F.expr("cast(conv(hex(substring(_bits, cast(_place div 8 as int) + 1, 1)), 16, 10) as int)")
    placed = rows.withColumns({"_bucket": F.bitmap_bucket_number(own), "_place": F.bitmap_bit_position(own)})
    hit = F.coalesce(F.bit_get(byte, (F.col("_place") % 8).cast("int")) == 1, F.lit(False))
    found = placed.join(F.broadcast(maps), "_bucket", "left").where(hit if inside else ~hit)  # BITS / 8 bytes at most
    return found.select(*rows.columns)


def join_spread(rows: DataFrame, known: DataFrame, key: str, uses: str, most: int = 1000) -> DataFrame:
    """rows left joined with known (one row for each key; `uses` is how many of rows have it), also if few keys hold most rows.

    Keys that more than one in `most` of the rows have are fewer than `most`: these are broadcast, all others shuffled.
    """
    total = known.agg(F.sum(uses)).first()[0] or 0
    often = F.col(uses) * most > total
    heavy, light = known.where(often).drop(uses), known.where(~often).drop(uses)
    one = rows.join(F.broadcast(heavy), key)
    two = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key, "left")
    return one.unionByName(two)


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(modulus)


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, with underscores until no column of df (whatever its case) has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset at which each row begins (one more for the end); null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def slices(column: pa.Array, size: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `size` bytes (a longer text makes a run of its own): first row, end row, bytes, offsets from 0."""
    data, offsets = utf8(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
