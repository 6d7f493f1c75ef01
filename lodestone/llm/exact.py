"""Exact duplicates by progressive refinement: lengths first, then hashes of prefixes, then hashes of whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common

#: Characters of the normal form that the second step hashes.
PREFIX = 128
#: Places of the bitmap that tells the second pass which texts are still in question: 8 MB, whatever the corpus.
BITS = 1 << 26


def normalised(text: Column) -> Column:
    """The text (null: empty) with each run of ASCII blanks replaced by one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _bit(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS)) + 1


def marked(rows: DataFrame, key: str, need: DataFrame, flag: str) -> DataFrame:
    """rows with a flag: false only where the key is not in need's only column. Of other keys, those that share a bit with one that is there are flagged too."""
    bit = _bit(need.columns[0])
    maps = need.groupBy(F.bitmap_bucket_number(bit).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_bits"))
    placed = rows.withColumns({"_bucket": F.bitmap_bucket_number(_bit(key)), "_place": F.bitmap_bit_position(_bit(key))})
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.bit_get(byte, (F.col("_place") % 8).cast("int")) == 1, F.lit(False))
    return placed.join(F.broadcast(maps), "_bucket", "left").select(*rows.columns, hit.alias(flag))


def duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", prefix: int = PREFIX, digests: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of docs; texts are equal when their normal forms are.

    A first pass over the texts keeps the length (in bytes) and a prefix hash of each. Texts that share their length are
    grouped by length and prefix hash, and only those that share both have their whole content hashed, in the second pass.
    text_sha256 is null for the others, unless `digests` asks for all. Texts are never shuffled; their hashes are counted
    before they are. What the second pass is told is a bitmap of fixed size: a text that it names in error is hashed in vain.

    Of equal texts the row with the smallest id stays: one row, even if several have that id. A row without an id stays only
    where none of the group has one, and keep_id is null then. A null text is an empty one; empty texts are one group, and
    those of blanks alone another. Long texts are read whole. A group may hold any share of all rows: it is summed before
    the shuffle, and what is known of a large one comes to its rows by broadcast. An empty table gives no rows; further
    columns, whatever their names, are not looked at.
    """
    read = docs.select(F.col(id_column).alias("_id"), normalised(F.col(text_column)).alias("_norm"))
    length, hashed = F.octet_length("_norm"), F.sha2("_norm", 256)
    alike = F.xxhash64(length, F.left("_norm", F.lit(prefix)))
    keys = common.saved(read.select(length.alias("_length"), alike.alias("_alike")), "exact-keys")
    lengths = keys.groupBy("_length").agg(F.count("*").alias("_n")).where("_n > 1").select("_length")
    shared = marked(keys, "_length", lengths, "_on").where("_on").groupBy("_alike").agg(F.count("*").alias("_n")).where("_n > 1").select("_alike")
    need = common.saved(shared, "exact-alike")
    found = marked(read.select("_id", "_norm", alike.alias("_alike"), F.monotonically_increasing_id().alias("_row")), "_alike", need, "_on")
    sha = hashed if digests else F.when(F.col("_on"), hashed)
    rows = common.saved(found.select("_id", "_row", "_on", sha.alias("_sha")), "exact-hashes")
    common.drop(keys, need)
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    groups = common.saved(rows.where("_on").groupBy("_sha").agg(F.count("*").alias("_n"), first.alias("_first")).where("_n > 1"), "exact-groups")
    sizes = groups.withColumn("_size", F.col("_n"))
    grouped = common.join_spread(rows.where("_on"), sizes, "_sha", "_n").select("_id", "_row", "_sha", "_size", "_first")
    alone = rows.where("NOT _on").select("_id", "_row", "_sha", F.lit(None).cast("long").alias("_size"), F.lit(None).cast(groups.schema["_first"].dataType).alias("_first"))
    return grouped.unionByName(alone).select(
        F.col("_id").alias("doc_id"), F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_first.id")).alias("keep_id"), F.coalesce("_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("_first.row") == F.col("_row"), F.lit(True)).alias("kept"), F.col("_sha").alias("text_sha256"),
    )
